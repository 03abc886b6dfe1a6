"""SQL twins of the queries that SQL can express on whole tables.

Components are closed by recursion over distinct keys; the related sets are
small, so this stays within seconds.
"""

from __future__ import annotations

from framelore.llm.canonical import DECORATION, HOMOGLYPHS, LEET, MARKED
from framelore.llm.keys import NO_DIGEST, SPLITS
from framelore.llm.survivors import FIELDS, STATUS_TRUST

# How a path names a shot, as one pattern each over the path with single underscores.
SHOT_PATTERNS: list[tuple[str, str]] = [
    ("video", r"(?:^|_)video_?([0-9a-f]{24})_(?:frame|f)_?0*([0-9]+)(?:_|$)"),
    ("shot", r"(?:^|_)cam_?([0-9]{2,4})(?:_[\p{L}]+[0-9]*)*_([0-9]{4})_?([0-9]{2})_?([0-9]{2})(?:_[\p{L}]+[0-9]*)*[t_]([0-9]{2})_?([0-9]{2})_?([0-9]{2})_0*([0-9]+)(?:_|$)"),
    ("roll", r"(?:^|_)dsc_?0*([0-9]{4,})(?:_|$)"),
]

_OUTER = r"[\s\x{A0}\x{200B}\x{FEFF}]+"
_BAD = ", ".join(f"'{x}'" for x in NO_DIGEST)


def _digest(column: str) -> str:
    bare = f"regexp_replace(lower(regexp_replace({column}, '[\\s\\x{{A0}}]+', '', 'g')), '^sha-?256[:=]', '')"
    return f"case when regexp_full_match({bare}, '[0-9a-f]{{64}}') and {bare} not in ({_BAD}) then {bare} end"


def _split(column: str) -> str:
    whens = " ".join(f"when regexp_replace(lower({column}), '[^a-z]', '', 'g') in ({', '.join(repr(f) for f in forms)}) then '{name}'" for name, forms in SPLITS.items())
    return f"case {whens} else 'unspecified' end"


def _shot() -> str:
    whens = []
    for kind, pattern in SHOT_PATTERNS:
        groups = pattern.count("(") - pattern.count("(?:")
        whens.append(f"when regexp_matches(spelled, '{pattern}') then concat_ws('|', '{kind}', {', '.join(f'regexp_extract(spelled, {chr(39)}{pattern}{chr(39)}, {i})' for i in range(1, groups + 1))})")
    return f"case {' '.join(whens)} end"


_FILES = f"""f0 as (select *, replace(path, '\\', '/') as p0 from images),
f1 as (select *, replace(case when regexp_matches(p0, '%[0-9A-Fa-f]{{2}}') then url_decode(replace(p0, '+', '%2B')) else p0 end, '\\', '/') as p1 from f0),
f2 as (select *, list_filter(string_split(nfc_normalize(lower(regexp_replace(p1, '^{_OUTER}|{_OUTER}$', '', 'g'))), '/'), lambda s: s not in ('', '.')) as segs from f1),
f3 as (select *, nullif(array_to_string(list_reduce(list_transform(segs, lambda s: [s]), lambda acc, x: case when x = ['..'] then acc[1:greatest(len(acc) - 1, 0)] else list_concat(acc, x) end, []::varchar[]), '/'), '') as fk from f2),
f4 as (select *, regexp_replace(fk, '[^\\pL\\pN]+', '_', 'g') as spelled, {_digest("sha256")} as dg, {_split("split")} as sp from f3),
rows_ as (select *, {_shot()} as sk from f4)"""

_CLASSES = f"""
with recursive {_FILES},
links as (select distinct 'f' || fk as a, 's' || sk as b from rows_ where fk is not null and sk is not null union select distinct 'f' || fk, 'd' || dg from rows_ where fk is not null and dg is not null),
shared as (select a, b from links where b in (select b from links group by b having count(*) > 1)),
steps as (select a, b from shared union select b, a from shared),
reach(node, other) as (select distinct a, a from steps union select r.node, s.b from reach r join steps s on r.other = s.a),
root as (select node, min(other) as root from reach group by 1),
cls as (select image_key, sp, coalesce(source_id, split_part(path, '/', 1)) as source, coalesce(root, 'f' || fk, 'd' || dg) as c from rows_ left join root on node = 'f' || fk)"""
_P1 = f"""{_CLASSES}
select distinct least(a.image_key, b.image_key) as image_key_a, greatest(a.image_key, b.image_key) as image_key_b
from cls a join cls b on a.c = b.c and a.sp = 'train' and b.sp in ('val', 'test') and a.image_key <> b.image_key"""

_P1_REPORT = f"""{_CLASSES},
t as (select c, count(*) as n from cls where sp = 'train' group by 1)
select sp as split, source, count(*) as records, count(n) as overlapping, coalesce(sum(n), 0)::bigint as pairs from cls left join t using (c) where sp in ('val', 'test') group by 1, 2"""

_P2 = f"with {_FILES} select distinct a.image_key as image_key_a, b.image_key as image_key_b from rows_ a join rows_ b on a.fk = b.fk and a.image_key < b.image_key"


_BEST = "(missing, trust, untrusted, age, image_key)"


def _ordered() -> str:
    """CTEs up to ``o``: rows with their group and order."""
    usable = {
        "source_id": "nullif(trim(source_id, ' '), '')", "source_path": "nullif(source_path, '')", "width": "case when width > 0 then width end", "height": "case when height > 0 then height end",
        "split": "nullif(sp, 'unspecified')", "status": "case when lower(trim(status, ' ')) in (" + ", ".join(f"'{s}'" for s in STATUS_TRUST) + ") then lower(trim(status, ' ')) end", "sha256": "dg", "provenance": "case when length(trim(provenance, ' ')) > 2 then provenance end",
    }
    fields = ", ".join(f"{v} as u_{k}" for k, v in usable.items())
    trust = "case u_status " + " ".join(f"when '{s}' then {i + 1}" for i, s in enumerate(STATUS_TRUST)) + " else 9 end"
    complete = " + ".join(f"(u_{f} is not null)::int" for f in FIELDS)
    return f"""
with {_FILES}, pol as (select source_id, bool_or(coalesce(lower(trim(duplicate_policy, ' ')) = 'keep_existing', false)) as keep, bool_or(coalesce(trust_reviewed, false)) as trusted from import_sources where source_id is not null group by 1),
u as (select image_key, path, coalesce(fk, '~' || image_key) as fk, imported_at, updated_at, {fields} from rows_),
o as (select u.*, {trust} as trust, (not coalesce(trusted, false))::int as untrusted, 0 - ({complete}) as missing,
  coalesce(case when coalesce(keep, false) then epoch_us(coalesce(imported_at, updated_at)) else -epoch_us(coalesce(updated_at, imported_at)) end, 4611686018427387904) as age
  from u left join pol on pol.source_id = coalesce(u_source_id, split_part(path, '/', 1)))"""


def _survivors() -> str:
    donors = ", ".join(f"arg_min(u_{f}, (trust, untrusted, age, image_key)) filter (u_{f} is not null) as {f}, arg_min(image_key, (trust, untrusted, age, image_key)) filter (u_{f} is not null) as {f}_from" for f in FIELDS)
    return f"{_ordered()} select arg_min(image_key, {_BEST}) as image_key, arg_min(path, {_BEST}) as path, {donors}, count(*) as records from o group by fk"


def _members() -> str:
    return f"{_ordered()}, top as (select fk, arg_min(image_key, {_BEST}) as k from o group by fk) select image_key, k::varchar as survivor, image_key = k as leads from o join top using (fk)"


def _recording(column: str) -> str:
    bare = f"regexp_replace(lower(regexp_replace({column}, '[\\s\\x{{A0}}]+', '', 'g')), '^sha-?256[:=]', '')"
    return f"coalesce('video-' || left({_digest(column)}, 24), case when regexp_full_match({bare}, 'video-[0-9a-f]{{24}}') then {bare} end)"


_P5 = f"""
with recursive r as (select video_key, coalesce({_recording("video_id")}, {_recording("sha256")}, 'row-' || video_key) as n, {_recording("sha256")} as s, {_recording("group_id")} as g, {_recording("derived_from")} as d from video_manifest),
e as (select distinct n as a, unnest([s, g, d]) as b from r), links as (select a, b from e where b is not null and a <> b), steps as (select a, b from links union select b, a from links),
reach(node, other) as (select distinct a, a from steps union select x.node, y.b from reach x join steps y on x.other = y.a),
root as (select node, min(other) as root from reach group by 1),
sets as (select distinct video_key, coalesce(root, n) as c from r left join root on node = n),
first as (select c, min(video_key) as k from sets group by 1)
select k as video_key_a, video_key as video_key_b from sets join first using (c) where video_key > k"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fold(v: str) -> str:
    wide, plain = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F)) + "\u3000", "".join(chr(i) for i in range(0x21, 0x7F)) + " "
    v = f"regexp_replace({v}, '[\\x{{200b}}-\\x{{200f}}\\x{{feff}}\\x{{ad}}\\p{{Mn}}]', '', 'g')"
    for _ in range(2):  # a match takes the letter that the next one would begin with
        v = f"regexp_replace({v}, '(\\p{{Ll}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    v = f"translate(translate({v}, {_quoted(wide)}, {_quoted(plain)}), {_quoted(HOMOGLYPHS[0])}, {_quoted(HOMOGLYPHS[1])})"
    v = f"translate(lower({v}), {_quoted(MARKED[0])}, {_quoted(MARKED[1])})"
    outer = "[\\s\\x{A0}''\"<>*!?]+"
    return f"regexp_replace({v}, '^{outer}|{outer}$', '', 'g')"


def _bare(v: str) -> str:
    for _ in range(2):
        for pattern in DECORATION:
            into = "\\1" if "(?=" in pattern else ""
            v = f"regexp_replace({v}, {_quoted(pattern.replace('(?=', '('))}, '{into}')"
    return v


def _words(v: str) -> str:
    return f"trim(regexp_replace({v}, '[^\\pL\\pN]+', ' ', 'g'), ' ')"


def _leet(v: str) -> str:
    return f"case when regexp_matches({v}, '\\pL[0-9]|[0-9]\\pL') then translate({v}, '{LEET[0]}', '{LEET[1]}') end"


_BAG = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_LETTERS = "array_to_string(list_sort(string_split({0}, '')), '')"
_P3_VALUES = f"""
with names as (select category_id, unnest(list_prepend(category_name, coalesce(aliases, []))) as name from label_catalog),
refs as (select form, min(category_id) as id, arg_min(name, (category_id, name)) as name from (select category_id, lower(name) as name, {_words(_fold("name"))} as form from names) where form <> '' group by 1),
mp as (select source_id, unnest(map_keys(category_mapping)) as k, unnest(map_values(category_mapping)) as t from import_sources),
meant as (select ann_key, coalesce(t, label) as value from annotations a left join mp on mp.source_id = a.import_source_id and mp.k = trim(label, ' ')
  where regexp_matches(label, '[^\\s\\x{{A0}}]') and label not in (select category_name from label_catalog)),
vals as (select distinct value, {_fold("value")} as f from meant), v2 as (select value, {_words("f")} as w, {_words(_bare("f"))} as b from vals),
ways as (select value, unnest([w, b, {_leet("b")}, {_leet("w")}]) as text, unnest([0, 1, 2, 3]) as way from v2),
rd as (select value, text, min(way) as way from ways where text <> '' group by 1, 2),
pre as (select text, min(id) as id from (select trim(left(form, m), ' ') as text, id from (select form, id, unnest(range(greatest(4, ceil(length(form) / 2)::int), length(form))) as m from refs)) group by 1 having min(id) = max(id)),
sure as (select value, id, way as cost from rd join refs on form = text
  union all select value, id, way + 10 from rd join refs on {_BAG.format("form")} = {_BAG.format("text")}
  union all select value, id, way + 20 from rd join refs on replace(form, ' ', '') = replace(text, ' ', '')
  union all select value, id, way + 30 from rd join pre using (text)),
settled as (select value, arg_min(id, (cost, id)) as id from sure group by 1),
near as (select value, way, id, form, name, levenshtein(text, form) as e, levenshtein({_LETTERS.format("text")}, {_LETTERS.format("form")}) as s
  from rd join refs on abs(length(text) - length(form)) <= 4 where value not in (select value from settled)),
fit as (select * from near where e <= case when length(form) <= 7 then 2 when length(form) <= 10 then 3 else 4 end
  and case when length(form) <= 5 then e <= 1 or (e = 2 and s = 0) else e <= 2 or (e = 3 and s <= 2) or (e = 4 and s = 0) end),
per as (select value, id, min((e, s, levenshtein(lower(value), name))) as d from fit group by 1, 2),
best as (select value, min(id) as id from (select *, rank() over (partition by value order by d) as r from per) where r = 1 group by 1 having count(*) = 1),
res as (select ann_key, meant.value, coalesce(settled.id, best.id, -1)::int as category_id from meant left join settled on settled.value = meant.value left join best on best.value = meant.value)"""
_P3 = _P3_VALUES + " select ann_key, category_id from res"
# Labels that are letter for letter a category name count here too.
_P3_UNMATCHED = _P3_VALUES.replace(" and label not in (select category_name from label_catalog)", "") + " select value, count(*) as annotations from res where category_id = -1 group by 1"

# The targets in whole rows; the largest split takes the rest.
_P5_TOTALS = """
with n as (select count(*) as n from video_manifest), t as (select split, target_share / sum(target_share) over () as share, row_number() over (order by target_share desc, split desc) as place from split_targets),
r as (select split, place, round_even(n * share, 0)::bigint as rows from t, n)
select split, case when place = 1 then n - (select sum(rows) from r where place > 1) else rows end::bigint as rows from r, n"""

ORACLES = {"p1_found": _P1, "p1_report": _P1_REPORT, "p2_found": _P2, "p2_survivors": _survivors(), "p2_members": _members(), "p3_found": _P3, "p3_unmatched": _P3_UNMATCHED, "p5_found": _P5, "p5_totals": _P5_TOTALS}
