"""Problem 10: detection on written cases, placeholders, and the properties of surrogates."""

import pytest

from framelore.llm import pii

CASES = [
    ("Mail jonas+x@annot.test or eva_b [at] qa [dot] test, not gate@2x.png, loader@25.310.1 or @crew.", [("email", "jonas+x@annot.test"), ("email", "eva_b [at] qa [dot] test")]),
    ("cc: ANNA.B @ EXAMPLE.COM; i (at) pier.example.net", [("email", "ANNA.B @ EXAMPLE.COM"), ("email", "i (at) pier.example.net")]),
    ("Call +49 (0)30 23125-646 if down. My mobile is (919) 555-0160, ok. Ticket 545-555-2301.", [("phone", "+49 (0)30 23125-646"), ("phone", "(919) 555-0160")]),
    ("请拨打 01 99 00 94 39。Frame ids 2125550060 and 3035550542 are missing. Call 3035550163 now.", [("phone", "01 99 00 94 39"), ("phone", "3035550163")]),
    ("fallback contact 030 23125 266 / 808.555.0187 please", [("phone", "030 23125 266"), ("phone", "808.555.0187")]),
    ("Passport 00 486 155 813 lies. Social security no. 666-45-6904 is. Lot ZX9633907 came, serial DL-5851-0247. Order no. 48814785U is.", [("id_number", "00 486 155 813"), ("id_number", "666-45-6904")]),
    ("The form lists ID QQ 84 35 84 C, phone 020 7946 0849 and the street Flat 8, 97 Kestrel Street, Port Ravel.", [("id_number", "QQ 84 35 84 C"), ("phone", "020 7946 0849"), ("address", "Flat 8, 97 Kestrel Street, Port Ravel")]),
    ("It is 108 FOUNDRY ST., BRACKWELL 47260. It is 11 Quarry Ave.. Street camera 14 and Road sensor 7.", [("address", "108 FOUNDRY ST., BRACKWELL 47260"), ("address", "11 Quarry Ave.")]),
    ("Auf dem Paket steht H. Velkmann, Tannerystraße 23b, 19106 Tarnsby.", [("person_name", "H. Velkmann"), ("address", "Tannerystraße 23b, 19106 Tarnsby")]),
    ("Sur le colis: Marvwek, Ivo, 29 bis, avenue Tannery, 70707 Brackwell.", [("person_name", "Marvwek, Ivo"), ("address", "29 bis, avenue Tannery, 70707 Brackwell")]),
    ("En la caja: LENA ROSKINHO, Avenida de Quarry, 116, 3.º B.", [("person_name", "LENA ROSKINHO"), ("address", "Avenida de Quarry, 116, 3.º B")]),
    ("Dr. Maria H. de la Ortlova-Velkby signs; kofi oslemoro too. Model Kestrel Mini beats Heron Large.", [("person_name", "Maria H. de la Ortlova-Velkby"), ("person_name", "kofi oslemoro")]),
    ("Ms Quentin Abernathy of the night shift asked.", [("person_name", "Quentin Abernathy")]),
    # Names of no list, told by the words around them, and their further mentions in the same text.
    ("Please ask Thorvald Quixwood about it. T. Quixwood knows; T.Quixwood.png does not. Thorvald Quixwood too.", [("person_name", "Thorvald Quixwood"), ("person_name", "T. Quixwood"), ("person_name", "Thorvald Quixwood")]),
    ("Then Xanthe Ormbury replied, and Иван Петров said no.", [("person_name", "Xanthe Ormbury"), ("person_name", "Иван Петров")]),
    ("We told Harbour Street and asked Camera North; the Hough Transform failed, Model Kestrel asked for more models.", []),
    # Common names.
    ("John Smith, Mary O'Neill and Wei Zhang met Priya Patel.", [("person_name", "John Smith"), ("person_name", "Mary O'Neill"), ("person_name", "Wei Zhang"), ("person_name", "Priya Patel")]),
    ("Cc: Elizabeth Taylor, William Turner, Noah Wilson, Robert Brown.", [("person_name", "Elizabeth Taylor"), ("person_name", "William Turner"), ("person_name", "Noah Wilson"), ("person_name", "Robert Brown")]),
    ("请联系王伟。昨天李小红说遮罩有洞，审核人：欧阳文。高度说明和方向表示请重新检查。", [("person_name", "王伟"), ("person_name", "李小红"), ("person_name", "欧阳文")]),
    # Long parts are found whole.
    ("mail " + "a" * 450 + "@x.org or a@" + "b" * 480 + ".org end", [("email", "a" * 450 + "@x.org"), ("email", "a@" + "b" * 480 + ".org")]),
    ("Now Anna K" + "r" * 300 + "berg calls", [("person_name", "Anna K" + "r" * 300 + "berg")]),
    ("", []),
    (None, []),
    ("a" * 300000 + " " + "1 " * 100000, []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find_entities(text)] == want


DOCS = "doc_id bigint, text string, entities string, row_id string"


def test_operator_rows(spark):
    rows = [(1, "😀 Mail a.b@qa.test", "x", "y"), (1, "😀 Mail a.b@qa.test", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (None, "Call +1 212 555 0114", "x", "y")]
    df = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in pii.found_entities(df).collect()} == {(1, "email", 7, 18), (None, "phone", 5, 20)}
    assert pii.found_entities(df).count() == 2 and pii.found_entities(df.limit(0)).count() == 0
    got = sorted((str(r["doc_id"]), str(r["text"]), r["entities"]) for r in pii.redacted_documents(df).collect())
    assert got == [("1", "😀 Mail [EMAIL]", 1), ("1", "😀 Mail [EMAIL]", 1), ("2", "None", 0), ("3", "", 0), ("None", "Call [PHONE]", 1)]


def test_stretches_lose_nothing():
    """Mail addresses and names found in stretches are those that the patterns find in the whole text."""
    import random

    rnd = random.Random(12)
    bits = ["a.b", "x_y+z", "@", " @ ", " (at) ", "[at]", "q.test", "long" * 150, "-", ".org", " [dot] com", "@@", " ", "\n", ", ", "Anna", "ivo", " de la ", "Velkberg", "Stadmann", "K. ", "J.", "Ş", "İ", "x" * 200, "(dot)", "Lena-Maria "]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(2, 14)))
        low = text.lower()
        spans = lambda pattern, windows, **how: sorted({m.span() for a, b in windows for m in pattern.finditer(text, a, b, **how)})
        whole = [(0, len(text))]
        if pii.AT_WRITTEN.search(low) or "@" in text:
            assert spans(pii.EMAIL, pii._mail_windows(text, low)) == spans(pii.EMAIL, whole), text
        for pattern in (pii.NAME_FORWARD, pii.NAME_TURNED):
            assert spans(pattern, pii._name_windows(text), overlapped=True) == spans(pattern, whole, overlapped=True), text


def test_redacted_texts():
    assert pii.redact("Ask John Smith (+44 20 7946 0884), J. Smith or j.smith@qa.test; 北京市朝阳区建国路88号.") == "Ask [PERSON_NAME] ([PHONE]), [PERSON_NAME] or [EMAIL]; [ADDRESS]."


def _surrogates(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["text"] for r in pii.surrogate_documents(df, key).collect()}


def test_surrogates(spark):
    texts = ["Ms Greta Velkinho called +44 20 7946 0884.", "ask VELKINHO, GRETA or g.v [at] qa [dot] test", "According to Viktor Tavrby, Passport ZX9735642, 81 Millrace Avenue, Brackwell 85037", "Nothing here.", None]
    got = _surrogates(spark, texts)
    assert got == _surrogates(spark, texts) and got != _surrogates(spark, texts, "other")
    assert got[3] == texts[3] and got[4] is None
    name = pii.NAME_FORWARD.search(got[0])
    assert name and name["given"].lower() in pii.words.GIVEN_F
    assert f"{name['family'].upper()}, {name['given'].upper()}" in got[1] and "[at] example [dot] org" in got[1]
    assert "+44 " in got[0] and "0884" not in got[0] and "ZX9735642" not in got[2] and "Avenue, " in got[2]
    with pytest.raises(ValueError):
        pii.surrogate_documents(spark.createDataFrame([], "doc_id bigint, text string"), "")


def test_surrogates_keep_script_gender_and_coreference(spark):
    texts = ["Ask John Smith about it; J. Smith and SMITH, JOHN know.", "请联系王伟女士，北京市朝阳区建国路88号。", "Frau Xanthe Ormbury sagte ja. Then Quill Zarnbrook said no.", "Then Иван Петров said no.", "Dr. Maria H. de la Ortlova-Velkby signs."]
    got = _surrogates(spark, texts)
    first = pii.regex.fullmatch(r"Ask (\w+) (\w+) about it; (\w)\. (\w+) and (\w+), (\w+) know\.", got[0])
    assert first and first[1].lower() in pii.words.GIVEN_M and first[3] == first[1][0] and first[4] == first[2] and (first[5], first[6]) == (first[2].upper(), first[1].upper())
    han = pii.regex.fullmatch(r"请联系(\p{Han}{2})女士，(\p{Han}{2})市(\p{Han}{2})区(\p{Han}{2})路(\d\d)号。", got[1])
    assert han and han[1] != "王伟" and han[1][1] in pii.words.HAN_GIVEN["f"] and han[2] != "北京"
    third = pii.regex.fullmatch(r"Frau (\w+) \w+ sagte ja\. Then (\w+) \w+ said no\.", got[2])
    assert third and third[1].lower() in pii.words.GIVEN_F and third[2].lower() in pii.words.GIVEN_N
    assert pii.regex.fullmatch(r"Then \p{Cyrillic}+ \p{Cyrillic}+ said no\.", got[3]) and "Петров" not in got[3]
    assert pii.regex.fullmatch(r"Dr\. \w+ \w\. de la \w+-\w+ signs\.", got[4]) and "Ortlova" not in got[4]


def test_surrogates_stay_distinct_as_rendered(spark):
    """3,000 numbers of one country: all different in the texts, none of them a number of the texts."""
    real = [f"+49 30 {100000 + 37 * i}" for i in range(3000)]
    got = _surrogates(spark, [f"Call {n} now." for n in real])
    keys = [pii.entity_key("phone", t[5:-5]) for t in got.values()]
    assert len(set(keys)) == 3000 and not set(keys) & {pii.entity_key("phone", n) for n in real} and all(t.startswith("Call +49 ") for t in got.values())
    names = _surrogates(spark, [f"Ms {g} Velk{chr(97 + i % 26)}{chr(97 + i // 26)}berg called; or {g[0]}. Velk{chr(97 + i % 26)}{chr(97 + i // 26)}berg." for i, g in enumerate(["Anna", "Greta"] * 150)])
    assert len({t.split(" called")[0] for t in names.values()}) == len(names) == 300


def test_few_possible_surrogates_grow(spark):
    rows = [("id_number", f"{i}", f"{i}", "") for i in range(10)] + [("id_number", f"a{i}", f"A{i}", "") for i in range(30)]
    got = pii.distinct_surrogates(spark.createDataFrame(rows, "pii_type string, entity string, mention string, gender string"), "k").collect()
    keys = {pii.entity_key("id_number", r["surrogate"]) for r in got}
    assert len(got) == 40 and len(keys) == 40 and not keys & {e for _, e, _, _ in rows}
