"""De-identification of element tables and its verification.

An element table has rows (entity, tag, vr, value) and, for nested elements,
``seq_path``, the tags of the sequences around them: an element goes with any
sequence around it that goes, so nesting needs no recursion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.functions.scalar import is_group_length, is_private, tag_group

#: Whole groups that go: curves and overlays (fixed values of the public format).
CURVES, OVERLAYS = (0x5000, 0x50FF), (0x6000, 0x60FF)
KNOWN_ROOTS = ("1.2.840.10008.", "2.25.")
#: Tags of identity stamps (fixed values of the public format).
NAME, PATIENT, REMOVED, METHOD, CODES = 0x00100010, 0x00100020, 0x00120062, 0x00120063, 0x00120064
CLASS, INSTANCE, META_CLASS, META_INSTANCE, WRITER = 0x00080016, 0x00080018, 0x00020002, 0x00020003, 0x00020012
META_GONE = (0x00020013, 0x00020016, 0x00020100, 0x00020102)
CODE = ((0x00080100, "SH", "113100"), (0x00080102, "SH", "DCM"), (0x00080104, "LO", "Basic Application Confidentiality Profile"))

ROWS = 512  # texts whose hits leave a task at once

Masks = list[tuple[int, int, int, int]]


def dropped(t: Column, masked: Masks = ()) -> Column:
    """Private, group-length, curve and overlay tags, and those a pattern (group, element, group mask, element mask) meets."""
    g = tag_group(t)
    out = is_private(t) | is_group_length(t) | g.between(*CURVES) | g.between(*OVERLAYS)
    for group, element, group_mask, element_mask in masked:
        out = out | (g.cast("long").bitwiseAND(F.lit(group_mask)) == group) & (F.pmod(t, F.lit(65536)).cast("long").bitwiseAND(F.lit(element_mask)) == element)
    return out


def hashed_hex(uid: Column, salt: str) -> Column:
    """The first 128 bits of sha256(salt, NUL, uid), as hex."""
    return F.substring(F.sha2(F.concat(F.lit(salt + "\0"), uid), 256), 1, 32)


def hashed_uid(uid: Column, salt: str) -> Column:
    """A 2.25 UID of 128 hashed bits, by exact decimal limbs (10^18 a limb)."""
    wide = "decimal(38,0)"
    base, two32, zero = (F.lit(n).cast(wide) for n in (10**18, 2**32, 0))
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  what is named in a lambda is computed once

    def carried(lo: Column, hi: Column) -> Column:
        carry = F.floor(lo / base).cast(wide)
        exact = carry - F.when(carry * base > lo, 1).otherwise(0)
        return bound(exact, lambda c: F.struct((hi * two32 + c).cast(wide).alias("hi"), (lo - c * base).cast(wide).alias("lo")))

    # value = hi * 10^18 + lo, 32 bits at a time
    step = lambda acc, limb: bound((acc["lo"] * two32 + limb).cast(wide), lambda lo: carried(lo, acc["hi"]))
    limbs = lambda h: F.transform(F.array(*map(F.lit, (1, 9, 17, 25))), lambda i: F.conv(F.substr(h, i, F.lit(8)), 16, 10).cast(wide))
    text = lambda v: F.when(v["hi"] > 0, F.concat(v["hi"].cast("string"), F.lpad(v["lo"].cast("string"), 18, "0"))).otherwise(v["lo"].cast("string"))
    digits = bound(hashed_hex(uid, salt), lambda h: F.aggregate(limbs(h), F.struct(zero.alias("hi"), zero.alias("lo")), step, text))
    return F.concat(F.lit("2.25."), digits)


def profile(table: DataFrame, kept: DataFrame, dropped_sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags to remove and tags to remap, from a published table (tag, action).

    UIDs (action U) are remapped, everything else goes but what is kept; the dropped
    sequences go whatever the table says of them.
    """
    tags = table.select("tag").distinct()
    uids = table.filter("action = 'U'").select("tag").distinct()
    gone = dropped_sequences.select("tag")
    return tags.exceptAll(uids).join(kept, "tag", "left_anti").union(gone).distinct(), uids.join(gone, "tag", "left_anti")


def remapped(value: Column, salt: str) -> Column:
    """Each part of a UID value hashed; blank parts of several go, a value without any stays as it is."""
    parts = F.filter(F.transform(F.split(value, r"\\"), lambda u: F.trim(u)), lambda u: u != "")
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda u: hashed_uid(u, salt)), "\\")).otherwise(value)


def without(elements: DataFrame, tags: DataFrame, rule: Callable[[Column], Column]) -> DataFrame:
    """``elements`` but those whose tag, or a tag of a sequence around them, is in the table ``tags`` or meets ``rule``.

    Paths of sequences are few and met once each, whatever the number of elements in them.
    """
    tags = tags.select("tag").distinct()
    e = elements.filter(~rule(F.col("tag"))).join(tags, "tag", "left_anti")
    if "seq_path" in elements.columns:
        e = e.filter(~F.exists(F.coalesce("seq_path", F.array().cast("array<long>")), rule))
        inside = elements.select("seq_path").distinct().withColumn("tag", F.explode("seq_path")).join(tags, "tag", "left_semi")
        e = e.join(inside.select("seq_path").distinct(), "seq_path", "left_anti")
    return e.select(*elements.columns)


def scrub(elements: DataFrame, remove: DataFrame, remap: DataFrame, masked: Masks, salt: str) -> DataFrame:
    """Elements that stay, values of ``remap`` tags hashed.

    ``remove`` and ``remap``: tables of tags (see ``profile``), of any size; ``masked``: the
    profile's patterns. What is removed stays removed if it is to be remapped too.
    """
    e = without(elements, remove, lambda t: dropped(t, masked))
    hashed = F.when(F.col("hashed"), remapped(F.col("value"), salt)).otherwise(F.col("value"))
    marked = e.join(remap.select("tag", F.lit(True).alias("hashed")).distinct(), "tag", "left")
    return marked.withColumn("value", hashed).select(*elements.columns)


def drop_named(elements: DataFrame, names: DataFrame) -> DataFrame:
    """Elements without the named and the private tags, at any depth."""
    return without(elements, names, is_private)


def stamp(elements: DataFrame, name: str, identity_removed: bool, methods: list[str], writer: str, patient: str = "DEMO", kept_method: str = "name kept") -> DataFrame:
    """Scrubbed elements with the identity fields of each entity set.

    With a real name the flag says NO, the method list says so, and no code is claimed.
    The file's own class and instance follow the image's; names of writers and
    private notes in the file's head go.
    """
    fields = [(NAME, "PN", name), (PATIENT, "LO", patient), (REMOVED, "CS", "YES" if identity_removed else "NO"), (METHOD, "LO", "\\".join(methods if identity_removed else [*methods, kept_method])), (WRITER, "UI", writer)]
    nested = [(t, vr, v, [CODES]) for t, vr, v in CODE] if identity_removed else []
    put = F.array(*(F.struct(F.lit(t).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.lit(v).alias("value"), F.array(*map(F.lit, path)).cast("array<long>").alias("seq_path")) for t, vr, v, path in [*((t, vr, v, []) for t, vr, v in fields), *nested]))
    old = elements if "seq_path" in elements.columns else elements.withColumn("seq_path", F.array().cast("array<long>"))
    top = F.size("seq_path") == 0
    replaced = [t for t, _, _ in fields] + [META_CLASS, META_INSTANCE, *META_GONE]
    rest = old.filter(~(top & F.col("tag").isin(replaced)) & ~F.exists("seq_path", lambda t: t == CODES))
    new = old.groupBy("entity").agg(F.lit(1)).select("entity", F.explode(put).alias("p")).select("entity", "p.*")
    heads = old.filter(top & F.col("tag").isin(CLASS, INSTANCE)).withColumn("tag", F.when(F.col("tag") == CLASS, META_CLASS).otherwise(META_INSTANCE).cast("long"))
    return rest.select("entity", "tag", "vr", "value", "seq_path").unionByName(new).unionByName(heads.select("entity", "tag", "vr", "value", "seq_path"))


def unmapped(elements: DataFrame, kept_tag: int = 0x00020012) -> DataFrame:
    """UI elements whose UID belongs to no known root."""
    ok = F.lit(False)
    for r in KNOWN_ROOTS:
        ok = ok | F.col("value").startswith(r)
    return elements.filter((F.col("vr") == "UI") & (F.col("tag") != kept_tag) & (F.col("value") != "") & ~ok)


def hits(elements: DataFrame, forbidden: DataFrame, most_bytes: int = 16 << 20, prefix: int = 8, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """entity, tag, term of element texts that contain a forbidden term, both folded.

    A list of up to ``most_bytes``, counted before, becomes one automaton that reads each
    text once, whatever the number of terms. Longer lists meet the texts through their
    first ``prefix`` characters: texts are cut into all substrings of that length, and
    only shared ones are compared.
    """
    f = forbidden.select(fold(F.trim("term")).alias("term")).filter("term <> ''").distinct()
    e = elements.select("entity", "tag", fold(F.col("value")).alias("low"))
    if (f.agg(F.sum(F.octet_length("term"))).first()[0] or 0) <= most_bytes:
        terms = elements.sparkSession.sparkContext.broadcast([r.term for r in f.collect()])
        found = e.mapInArrow(_finder(terms), f"entity {elements.schema['entity'].dataType.simpleString()}, tag {elements.schema['tag'].dataType.simpleString()}, term string")
        return found.distinct()

    def cut(n: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low") - n + 1))
        return e.withColumn("g", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("low"), i, F.lit(n))))))

    found = cut(prefix).join(f.filter(F.length("term") >= prefix).withColumn("g", F.substring("term", 1, prefix)), "g").filter(F.col("low").contains(F.col("term")))
    for n in range(1, prefix):  # the few shorter terms: each length cuts the texts its own way
        found = found.unionByName(cut(n).join(f.filter(F.length("term") == n).withColumn("g", F.col("term")), "g"))
    return found.select("entity", "tag", "term").distinct()


def _finder(terms):
    """An Arrow function from (entity, tag, text) to (entity, tag, term) of the terms found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for t in terms.value:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for b in batches:
            # texts one by one, hits in slices without the texts, however many terms a text holds
            for start in range(0, b.num_rows if terms.value else 0, ROWS):
                texts, at, found = b.column(2).slice(start, ROWS), [], []
                for i, text in enumerate(texts):
                    own = {t for _, t in automaton.iter(text.as_py() or "")}
                    at += [i] * len(own)
                    found += own
                rows = [b.column(n).slice(start, ROWS).take(pa.array(at, pa.int64())) for n in (0, 1)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(found, pa.string())], ["entity", "tag", "term"])

    return run


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_hits(files: DataFrame, forbidden: DataFrame, **how) -> DataFrame:
    """entity, term of files (entity, content) whose raw bytes hold a lower-cased term, as Latin-1 or as UTF-16; A-Z of the bytes are folded."""
    secret = F.lower(F.trim("term"))
    latin = F.regexp_replace(secret, r"[^\x00-\xff]", "")  # what Latin-1 has no letter for is left out
    wide = F.decode(F.encode(secret, "UTF-16LE"), "ISO-8859-1")
    needles = forbidden.filter(secret != "").select(secret.alias("secret"), F.explode(F.array(latin, wide)).alias("needle"))
    needles = needles.withColumn("term", ascii_lower(F.trim("needle"))).filter("term <> ''").drop("needle").distinct()
    texts = files.select("entity", F.lit(0).alias("tag"), F.decode("content", "ISO-8859-1").alias("value"))
    found = hits(texts, needles.select("term"), fold=ascii_lower, **how)
    return found.join(needles, "term").select("entity", F.col("secret").alias("term")).distinct()


def report(elements: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row: elements, entities, private tags, unmapped UIDs, repeated UIDs, hits."""
    uid = F.col("vr") == "UI"
    base = elements.agg(F.count("*").alias("elements"), F.count_distinct("entity").alias("entities"), F.count_if(is_private(F.col("tag"))).alias("private_tags"), (F.count_if(uid) - F.count_distinct(F.when(uid, F.col("value")))).alias("repeated_uids"))
    return base.join(unmapped(elements).agg(F.count("*").alias("unmapped_uids"))).join(hits(elements, forbidden).agg(F.count("*").alias("hits")))
