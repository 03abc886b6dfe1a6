"""Identity keys of picture records: file, shot and digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digests that stand for no picture (empty file, zeros).
NO_DIGEST = ["e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "0" * 64]
# Letters a decomposed accent can stand on, and the composed result.
DECOMPOSED = {
    "̀": ("aeiou", "àèìòù"),
    "́": ("aeiouyn", "áéíóúýń"),
    "̂": ("aeiou", "âêîôû"),
    "̃": ("aon", "ãõñ"),
    "̈": ("aeiouy", "äëïöüÿ"),
    "̧": ("c", "ç"),
    "̌": ("cszrn", "čšžřň"),
}
# Split names as they are typed.
SPLITS = {"train": ["train", "training"], "val": ["val", "valid", "validation", "dev"], "test": ["test", "testing"]}


def canonical_split(split: Column) -> Column:
    """train, val, test, or unspecified for anything else (null and blank included)."""
    bare = F.regexp_replace(F.lower(split), r"(?U)[^a-z]", "")
    out = None
    for name, forms in SPLITS.items():
        out = (F if out is None else out).when(bare.isin(forms), name)
    return out.otherwise("unspecified")


def digest(sha: Column) -> Column:
    """64 lower-case hex digits, or null where there is no digest or it stands for no picture."""
    plain = r"^[0-9a-f]{64}\z"
    bare = F.regexp_replace(F.lower(F.regexp_replace(sha, r"(?U)\s+", "")), "^sha-?256[:=]", "")
    return F.when(sha.rlike(plain), F.when(~sha.isin(NO_DIGEST), sha)).when(bare.rlike(plain) & ~bare.isin(NO_DIGEST), bare)


def compose(text: Column) -> Column:
    """Lower-case letters with a combining accent become single letters; a text without such accents is passed through."""
    whole_text = text
    for accent, (bases, composed) in DECOMPOSED.items():
        for base, whole in zip(bases, composed):
            whole_text = F.replace(whole_text, F.lit(base + accent), F.lit(whole))
    return F.when(text.rlike("[\\x{300}-\\x{36f}]"), whole_text).otherwise(text)


def file_key(path: Column) -> Column:
    """The file a path names: slashes, dots, doubled slashes, percent codes, outer blanks, case and accents made uniform.

    Expressions only.  A ".." takes the segment before it; at the root it is
    dropped, as file systems do.  Null or empty gives null.
    """
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    # Percent codes only where they are whole, and never "+" as a blank.
    coded = plain.rlike("%[0-9A-Fa-f]{2}") & ~plain.rlike("%(?![0-9A-Fa-f]{2})")
    plain = F.when(coded, F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)).otherwise(plain)
    plain = compose(F.lower(F.regexp_replace(F.replace(plain, F.lit("\\"), F.lit("/")), r"(?U)^[\s\x{200b}\x{feff}]+|[\s\x{200b}\x{feff}]+$", "")))
    kept = F.aggregate(
        F.split(plain, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg.isin("", "."), acc).when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, seg)),
    )
    # Most paths have no segment to drop.
    joined = F.when(plain.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), F.array_join(kept, "/")).otherwise(plain)
    return F.when(F.length(joined) > 0, joined)


def spell(path: Column) -> Column:
    """Letters and digits with single separators, for shot names that lost or changed theirs."""
    return F.regexp_replace(path, r"[^\p{L}\p{N}]+", "_")


# Words that announce a camera, a video, a frame and a roll number.
SHOT_WORDS = {"cam": ["cam", "camera", "kamera", "camara", "caméra"], "video": ["video", "vid", "clip"], "frame": ["frame", "fr", "f"], "dsc": ["dsc", "dscn", "dscf"]}
_B, _E = "(?<=_)", "(?=_)"
_NOISE = r"(?:_\p{L}+[0-9]*)*"


def _any(kind: str) -> str:
    return "(?:" + "|".join(SHOT_WORDS[kind]) + ")"


def name_text(path_key: Column) -> Column:
    """The words of a file key that hold digits, each way to write a number made uniform; borders are single underscores.

    ``cam070``, ``20230109`` and ``072820_1836`` for a camera, a day and a
    moment with its running number; ``video<id>_frame<n>``; ``dsc<n>``.  Words
    of letters alone say nothing about a shot and are left out, so the same
    shot stored in many folders is one text.
    """
    text = F.concat(F.lit("_"), spell(path_key), F.lit("_"))
    steps = {
        "video": [(rf"{_B}{_any('video')}_?([0-9a-f]{{24}})_{_any('frame')}_?0*([0-9]+){_E}", "video$1_frame$2")],
        "cam": [
            (rf"{_B}{_any('cam')}_?([0-9]{{2,4}}){_E}", "cam$1"),
            (rf"{_B}([0-9]{{4}})_?([0-9]{{2}})_?([0-9]{{2}})t?(?=_|[0-9]{{6}}_)", "$1$2$3_"),
            (rf"_+t?([0-9]{{2}})_?([0-9]{{2}})_?([0-9]{{2}})_0*([0-9]+){_E}", "_$1$2$3_$4"),
        ],
        "dsc": [(rf"{_B}{_any('dsc')}_?0*([0-9]{{4,}}){_E}", "dsc$1")],
    }
    for kind, replacements in steps.items():
        uniform = text
        for pattern, into in replacements:
            uniform = F.regexp_replace(uniform, pattern, into)
        # A search for the kind's first letters is far cheaper than its patterns; most names are of one kind.
        says = [text.contains("_" + start) for start in sorted({w for w in SHOT_WORDS[kind] if not any(v != w and w.startswith(v) for v in SHOT_WORDS[kind])})]
        text = F.when(reduce(lambda a, b: a | b, says), uniform).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, r"_(?!video[0-9a-f]{24}_)\p{L}+(?=_)", ""), "__+", "_")
    return F.when(F.length(text) > 1, text)


# What a passage of a name can end with; the place by which passages and texts find each other.
ANCHOR = rf"{_B}(?:[0-9]{{6}}_[0-9]+|video[0-9a-f]{{24}}_frame[0-9]+|dsc[0-9]{{4,}}){_E}"


def shot_passage(name: Column) -> Column:
    """The words, joined by blanks, that a text must hold to name the same shot as ``name`` (see ``name_text``); null where it names none.

    One frame of one video; one camera, day, moment and running number; or one
    roll number.  A moment without its camera is no shot.
    """
    out: Column | None = None
    for kind, pattern, into in (
        ("_video", r"^.*?_(video[0-9a-f]{24}_frame[0-9]+)_.*$", "$1"),
        ("_cam", rf"^.*?_(cam[0-9]{{2,4}}){_NOISE}_([0-9]{{8}}){_NOISE}_([0-9]{{6}}_[0-9]+)_.*$", "$1 $2 $3"),
        ("_dsc", r"^.*?_(dsc[0-9]{4,})_.*$", "$1"),
    ):
        out = (F if out is None else out).when(name.contains(kind) & name.rlike(pattern), F.regexp_replace(name, pattern, into))
    return out
