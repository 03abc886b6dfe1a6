"""Pictures by their headers, archives by their listing."""

from __future__ import annotations

import io
import stat
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.functions.text import portable_path

# File types that are read.
IMAGE_TYPES = ["jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp"]
VIDEO_TYPES = ["mp4", "mov", "mkv", "avi", "webm", "m4v", "mpg", "mpeg", "mts", "m2ts"]
# Limits of an archive.
MAX_FILES, MAX_BYTES, MAX_RATIO = 100_000, 20 * 1024**3, 1000


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height from a picture's header; ValueError if it is not one of the known types."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                break
            mark = data[at + 1]
            if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD8:
                at += 1 if mark == 0xFF else 2
                continue
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    if data[:4] in (b"II*\x00", b"MM\x00*"):
        order = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(order + "I", data[4:8])[0]
        found = {}
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            tag, kind, _, raw = struct.unpack(order + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
            if tag in (256, 257):
                found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
        if len(found) == 2:
            return found[256], found[257]
    raise ValueError("not a picture with a readable header")


def list_files(spark: SparkSession, root: str, types: list[str], content: bool = True) -> DataFrame:
    """Files of the given types under a folder, without "._" companions: path (relative), length, modified, content."""
    pattern = "*.{" + ",".join([t for x in types for t in (x, x.upper())]) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    listed = rows.withColumn("file", F.substring_index("path", base, -1)).where(~F.col("file").rlike(r"(^|/)\._[^/]*$"))
    names = [F.col("file").alias("path"), "length", F.col("modificationTime").alias("modified")]
    return listed.select(*names, "content") if content else listed.select(*names)


def picture_table(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pictures, issues) of listed files: path, width, height, sha256; unreadable files and paths that are not portable are issues."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    w, h = image_size(bytes(data))
                    out.append((path, w, h, None) if w > 0 and h > 0 else (path, None, None, "no size"))
                except (ValueError, struct.error, IndexError) as e:
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "fault"]).astype({"width": "Int32", "height": "Int32"})

    read = files.select("path", "content").mapInPandas(run, "path string, width int, height int, fault string")
    fault = F.coalesce("fault", F.when(~portable_path(F.col("path")), "path is not portable"))
    good = read.where(fault.isNull()).select("path", "width", "height").join(files.select("path", F.sha2("content", 256).alias("sha256")), "path")
    issues = read.where(fault.isNotNull()).select(F.lit("unreadable_image").alias("code"), F.col("path").alias("location"), fault.alias("message"), F.lit("error").alias("severity"))
    return good, issues


def changed_files(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Stored files (path, length, modified, sha256) that are gone or differ: path, why.  Equal size and time count as unchanged; else the digest decides."""
    fresh = now.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"), F.col("sha256").alias("_s"))
    same = (F.col("length") == F.col("_l")) & (F.col("modified") == F.col("_m")) | (F.col("sha256") == F.col("_s"))
    why = F.when(F.col("_l").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "changed")
    return stored.join(fresh, "path", "left").select("path", why.alias("why")).where("why is not null")


def resolve_sources(paths: list[str], limit: int = 1000) -> list[str]:
    """Video files to import, in order and each once; a list of user input, checked on the driver."""
    import os

    found: dict[str, None] = {}
    for p in paths:
        full = os.path.abspath(os.path.expanduser(p))
        if os.path.islink(full) or not os.path.exists(full):
            raise ValueError(f"not a file or folder: {p}")
        names = [full] if os.path.isfile(full) else [os.path.join(d, n) for d, _, ns in os.walk(full) for n in sorted(ns)]
        for n in names:
            if n.rsplit(".", 1)[-1].lower() in VIDEO_TYPES and not os.path.islink(n):
                found[n] = None
    if len(found) > limit:
        raise ValueError("too many video files")
    return list(found)


def open_archive(data: bytes, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, must_have: str = "categories.json") -> dict[str, bytes]:
    """The members of a snapshot archive, or ValueError: too many or too large, unsafe or colliding names, links, encryption, suspicious packing, no catalog."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        infos = archive.infolist()
    except (zipfile.BadZipFile, NotImplementedError) as e:
        raise ValueError(f"not a readable archive: {e}") from None
    if len(infos) > max_files or sum(i.file_size for i in infos) > max_bytes:
        raise ValueError("archive too large")
    seen: set[str] = set()
    for info in infos:
        name = info.filename.rstrip("/")
        parts = name.split("/")
        if not name or name != name.strip() or "\\" in name or ":" in name or name.startswith("/") or ".." in parts or any(ord(c) < 32 for c in name):
            raise ValueError(f"unsafe name in archive: {name!r}")
        if name.casefold() in seen:
            raise ValueError(f"two members share a name: {name}")
        seen.add(name.casefold())
        kind = stat.S_IFMT(info.external_attr >> 16)
        if kind and kind not in (stat.S_IFREG, stat.S_IFDIR):
            raise ValueError(f"link or special file in archive: {name}")
        if info.flag_bits & 1 or info.file_size > max(1, info.compress_size) * MAX_RATIO:
            raise ValueError(f"encrypted or suspiciously packed: {name}")
    if must_have not in seen:
        raise ValueError(f"archive without {must_have}")
    out, total = {}, 0
    for info in infos:
        if info.is_dir():
            continue
        body = archive.read(info)
        total += len(body)
        if total > max_bytes:
            raise ValueError("archive too large")
        out[info.filename] = body
    return out


def archive_files(archives: DataFrame) -> DataFrame:
    """(archive, file, content, fault) of archives (path, content): members as text rows, or one row with the fault."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                try:
                    rows = [(path, n, c.decode("utf-8", "replace"), None) for n, c in open_archive(bytes(data)).items()]
                except ValueError as e:
                    rows = [(path, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "file", "content", "fault"])

    return archives.select("path", "content").mapInPandas(run, "archive string, file string, content string, fault string")


def pack_archive(files: DataFrame, target: str) -> int:
    """Writes (file, content) rows into one ZIP at a local path, streaming from the executors; returns the number of members.

    One archive is one sequential file by nature; rows come partition by
    partition, so the driver holds one partition at a time.
    """
    import os

    part, n = f"{target}.{os.getpid()}.part", 0
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as out:
        for row in files.toLocalIterator():
            out.writestr(row["file"], row["content"])
            n += 1
    os.replace(part, target)
    return n
