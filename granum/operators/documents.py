"""Document operators: chunking, section splitting, boundary quality.

Sentences are cut by the JVM's regular expressions; only what depends on sums along a
document (packing, the best chain of headings) runs in Arrow batches, on arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk sizes, section limits and the canonical order and titles of sections.
TARGET, MAXIMUM, OVERLAP, MINIMUM, STRIDE = 1500, 2000, 200, 300, 1300
TOC_GAP, TOC_ITEMS, SECTION_MIN, LOOK_BACK = 400, 10, 400, 90
#: Headings of a task on average.
TASK_HEADINGS = 1 << 20
ITEM_TITLES = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "1C": "Cybersecurity", "2": "Properties", "3": "Legal Proceedings", "4": "Mine Safety Disclosures",
    "5": "Market for Registrant's Common Equity", "6": "Selected Financial Data", "7": "Management's Discussion and Analysis", "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data", "9": "Changes in and Disagreements with Accountants", "9A": "Controls and Procedures", "9B": "Other Information",
    "9C": "Disclosure Regarding Foreign Jurisdictions", "10": "Directors, Executive Officers and Corporate Governance", "11": "Executive Compensation", "12": "Security Ownership",
    "13": "Certain Relationships and Related Transactions", "14": "Principal Accountant Fees and Services", "15": "Exhibits and Financial Statement Schedules", "16": "Form 10-K Summary",
}
ITEMS = list(ITEM_TITLES)
CORE_ITEMS = ("1", "1A", "1C", "3", "7", "7A")
ABBREVIATIONS = "inc corp co ltd llc plc no nos u.s u.k approx est fig vs etc al jr sr mr ms dr st ave dept div ref sec fasb e.g i.e".split()
CUES = "refer to;refers to;reference to;references to;see;described in;discussed in;conjunction with;set forth in;included in;contained in;listed in;as defined in".split(";")
OPENERS, QUOTES, BULLET = "A-Z“‘\"(•", "\"“‘'", "•"

#: Behind an abbreviation that is all of the letters and dots before a break.
_ABBREVIATED = r"(?<=(?<![A-Za-z.])\.{0,3}(?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.{1,3})"
#: The same denied, also from behind the one space that such a break becomes.
_NOT_ABBREVIATED = _ABBREVIATED.replace("(?<=", "(?<!", 1)[:-1] + " ?)"


def fixed_chunks(df: DataFrame, id_col: str, text_col: str, width: int = TARGET, stride: int = STRIDE, least: int = MINIMUM) -> DataFrame:
    """``id, chunk_index, text`` windows; later pieces under ``least`` characters go, empty texts give none."""
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(stride))
    cut = df.where(F.length(text_col) > 0).select(id_col, F.col(text_col).alias("t"), F.posexplode(starts).alias("chunk_index", "s"))
    return cut.select(id_col, "chunk_index", F.substr("t", F.col("s") + 1, F.lit(width)).alias("text")).where((F.col("chunk_index") == 0) | (F.length("text") >= least))


def sentence_patterns() -> tuple[str, str, str]:
    """What becomes one space, what parts sentences, and what is trimmed off them.

    A place is tried for abbreviations, which are looked for backwards at every length, only
    where the characters around it can be a break at all.
    """
    gap = rf"(?:\s+(?=[{OPENERS}])|\s*(?={BULLET}))"
    at = rf"(?=[\s{BULLET}])"
    parting = rf"(?:(?<=[.!?])(?=\s+[{OPENERS}]){_NOT_ABBREVIATED}\s+|(?=\s*{BULLET}){_NOT_ABBREVIATED}\s*)"
    return rf"(?U)(?<=\.){at}{_ABBREVIATED}{gap}", rf"(?U){at}{parting}", r"(?U)^\s+|\s+$"


def sentences(text: Column) -> Column:
    """Sentences of a text as an array: cut behind ``.!?`` before an opening character, and at bullets.

    A break behind an abbreviation is none; its white space becomes one space.  Null and
    blank texts have no sentence.
    """
    joined, parting, trimmed = sentence_patterns()
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), joined, " "), parting)
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, trimmed, "")), lambda p: p != "")


def bounded_parts(parts: Column, most: int = MAXIMUM) -> Column:
    """The strings of an array, those longer than ``most`` cut in stretches of it."""
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(most)), lambda s: F.substr(p, s + 1, F.lit(most)))
    return F.flatten(F.transform(parts, cut))


def chunk_bounds(lengths: list[int]) -> list[tuple[int, int]]:
    """``(first, end)`` part numbers of each chunk of parts with these lengths.

    With ``ends[i]`` the length of the first ``i`` parts and their spaces, a chunk from
    part ``a`` ends at the last ``b`` with ``ends[b] - ends[a] <= TARGET`` (one new part at
    least), and the next starts at the first ``a`` with ``ends[b] - ends[a] <= OVERLAP + 1``,
    or at ``b`` where the next part would not fit with that overlap.
    """
    ends = np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.int64) + 1)))
    n, a, b, out = len(lengths), 0, 0, []
    while b < n:
        b = max(b + 1, int(np.searchsorted(ends, ends[a] + TARGET, "right")) - 1)
        out.append((a, b))
        if b < n:
            a = max(a, int(np.searchsorted(ends, ends[b] - OVERLAP - 1, "left")))
            a = b if ends[b] - ends[a] + lengths[b] > MAXIMUM else a
    return out


def pack_sentences(parts: list[str]) -> list[str]:
    """Chunks of whole sentences near ``TARGET`` with an overlap of whole sentences.

    A last chunk under ``MINIMUM`` joins the one before if both fit in ``MAXIMUM``.
    """
    texts = [" ".join(parts[a:b]) for a, b in chunk_bounds([len(p) for p in parts])]
    if len(texts) > 1 and len(texts[-1]) < MINIMUM and len(texts[-2]) + 1 + len(texts[-1]) <= MAXIMUM:
        texts[-2:] = [" ".join(texts[-2:])]
    return texts


def structural_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, chunk_index, text`` by sentences; only packing leaves the JVM."""
    parts = df.select(F.col(id_col), bounded_parts(sentences(F.col(text_col))).alias("_parts"))
    schema = T.StructType([parts.schema[id_col], T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [pack_sentences(p) for p in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
            index = [i for c in chunks for i in range(len(c))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(index, pa.int32()), pa.array([t for c in chunks for t in c], pa.string())], names=schema.names)

    return parts.mapInArrow(packed, schema)


def context_header(ticker: Column, year: Column, item: Column) -> Column:
    """One line that tells where a chunk is from; a null item is the whole filing."""
    title = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ITEM_TITLES.items() for x in kv]), item), F.lit(""))
    where = F.when(item.isNull(), "full filing").otherwise(F.regexp_replace(F.concat(F.lit("Item "), item, F.lit(". "), title), r"^[. ]+|[. ]+$", ""))
    return F.concat(ticker, F.lit(" fiscal year "), year.cast("string"), F.lit(" 10-K, "), where)


def headings(text: Column) -> Column:
    """Candidate section headings of a text as ``array<struct<pos, rank>>``, in order.

    A heading is ``Item``, a number with an optional letter, and a stop, colon or dash.  One
    that a citing phrase introduces in the ``LOOK_BACK`` characters before, or an opening
    quote, is none, nor is one outside the canonical order.
    """
    mark = r"(?iU)\bItem\s+\d{1,2}\s*[A-C]?\s*[.:\-–—]"
    between, found = F.split(text, mark, -1), F.regexp_extract_all(text, F.lit(mark), F.lit(0))
    sizes = F.zip_with(between, found, lambda x, m: F.struct(F.length(x).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), m.alias("mark")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<pos:int,mark:string>>").alias("out"))
    step = lambda s, x: F.struct((s["end"] + x["gap"] + x["size"]).alias("end"), F.when(x["mark"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct((s["end"] + x["gap"]).alias("pos"), x["mark"].alias("mark"))))).alias("out"))
    placed = F.aggregate(sizes, start, step, lambda s: s["out"])
    cue = r"(?i)\b(?:" + "|".join(CUES) + r")\b[^.;]{0,40}$"
    order = F.array(*map(F.lit, ITEMS))

    def judged(x: Column) -> Column:
        before = F.substr(text, F.greatest(x["pos"] - LOOK_BACK, F.lit(0)) + 1, F.least(x["pos"], F.lit(LOOK_BACK)))
        item = F.upper(F.regexp_replace(F.regexp_extract(x["mark"], r"(?iU)Item\s+(\d{1,2}\s*[A-C]?)", 1), r"(?U)\s", ""))
        cited = F.rlike(before, F.lit(cue)) | F.rlike(before, F.lit(rf"(?U)[{QUOTES}]\s*$"))
        return F.struct(x["pos"].alias("pos"), F.when(cited, -1).otherwise(F.array_position(order, item).cast("int") - 1).alias("rank"))

    return F.filter(F.transform(placed, judged), lambda x: x["rank"] >= 0)


def without_contents_page(pos: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which headings are left without the first island of close, ascending ones that has enough items."""
    new = np.concatenate(([True], (np.diff(pos) > TOC_GAP) | (np.diff(rank) <= 0)))[: len(pos)]
    island = np.cumsum(new)
    large = np.flatnonzero(np.bincount(island) >= TOC_ITEMS)
    return island != large[0] if len(large) else np.ones(len(pos), dtype=bool)


def best_chain(pos: np.ndarray, rank: np.ndarray, end: int) -> list[int]:
    """Headings of ascending rank with the most substantial sections, then the most headings.

    Ranks are taken from low to high; a heading of one rank extends the best of all
    earlier ones of lower rank.  A value counts a section as more than all headings
    together, and among equals the earliest heading is extended, and chosen last.
    """
    section = len(pos) + 1
    value, before = np.zeros(len(pos), dtype=np.int64), np.full(len(pos), -1)
    low: np.ndarray = np.zeros(0, dtype=np.int64)
    for r in np.unique(rank):
        own = np.flatnonzero(rank == r)
        if len(low):
            gain = value[low][None, :] + section * (pos[own][:, None] - pos[low][None, :] >= SECTION_MIN)
            gain[low[None, :] > own[:, None]] = -1
            pick = gain.argmax(axis=1)
            reached = gain[np.arange(len(own)), pick]
            before[own] = np.where(reached >= 0, low[pick], -1)
            value[own] = np.maximum(reached, 0)
        value[own] += 1
        low = np.sort(np.concatenate((low, own)))
    chain, at = [], int(np.argmax(value + section * (end - pos >= SECTION_MIN))) if len(pos) else -1
    while at >= 0:
        chain.append(at)
        at = int(before[at])
    return chain[::-1]


def sections(pos: np.ndarray, rank: np.ndarray, end: int) -> list[tuple[str, int, int]]:
    """``(item, start, stop)`` between the headings of the best chain, the contents page left out."""
    left = without_contents_page(pos, rank)
    pos, rank = pos[left], rank[left]
    chain = best_chain(pos, rank, end)
    stops = [*pos[chain[1:]].tolist(), end]
    return [(ITEMS[rank[i]], int(pos[i]), stop) for i, stop in zip(chain, stops, strict=False)]


def section_split(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, item, start, stop, parsed_by, body`` of the sections of a filing.

    Sections under ``SECTION_MIN`` characters go; with fewer than two core items left the
    whole text is one section.
    """

    @F.pandas_udf("array<struct<item:string,start:int,stop:int>>")
    def cut(heads: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(hs: list, n: int) -> list[dict]:
            pos, rank = (np.array([h[k] for h in hs], dtype=np.int64) for k in ("pos", "rank"))
            return [{"item": i, "start": a, "stop": b} for i, a, b in sections(pos, rank, n)]

        return pd.Series([one(h, n) for h, n in zip(heads, sizes, strict=True)])

    text = F.coalesce(F.col(text_col), F.lit(""))
    held = df.select(id_col, text.alias("_t")).withColumn("_h", headings(F.col("_t")))
    held = held.withColumn("_s", cut("_h", F.length("_t")))
    body = lambda a, b: F.regexp_replace(F.substr(F.col("_t"), a + 1, b - a), r"(?U)^\s+|\s+$", "")
    long = F.filter("_s", lambda s: F.length(body(s["start"], s["stop"])) >= SECTION_MIN)
    held = held.withColumn("_l", long)
    enough = F.size(F.filter("_l", lambda s: s["item"].isin(*CORE_ITEMS))) >= 2
    full = F.array(F.struct(F.lit("FULL").alias("item"), F.lit(0).alias("start"), F.length("_t").alias("stop")))
    out = held.select(id_col, "_t", F.when(enough, "items").otherwise("size_fallback").alias("parsed_by"), F.explode(F.when(enough, F.col("_l")).otherwise(full)).alias("_x"))
    return out.select(id_col, "_x.item", "_x.start", "_x.stop", "parsed_by", body(F.col("_x.start"), F.col("_x.stop")).alias("body"))


def heading_runs(df: DataFrame, doc: str, pos: str, rank: str, gap: int, least: int) -> DataFrame:
    """``doc, start, stop, n_items`` of the first run of close, ascending headings with enough items.

    Documents are dealt to as many tasks as their headings ask for, since headings are so
    narrow that partitions of even bytes would hold many millions of them. A heading without a rank
    comes behind those of its place, as in SQL, and ends the run there.
    """
    parts = 1 + df.count() // TASK_HEADINGS
    df = df.repartition(parts, doc) if parts > 1 else df
    w = Window.partitionBy(doc).orderBy(F.asc_nulls_last(pos), F.asc_nulls_last(rank))
    near = (F.col(pos) - F.lag(pos).over(w) <= gap) & (F.col(rank) > F.lag(rank).over(w))
    marked = df.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(doc, "_run").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count(rank).alias("n_items")).where(F.col("n_items") >= least)  # ranks of a run ascend
    return runs.groupBy(doc).agg(F.min(F.struct("start", "stop", "n_items")).alias("r")).select(doc, "r.*")


def boundary_quality(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Shares of chunks that start or end in the middle of a sentence, and of clean ones."""
    t = F.trim(text_col)
    start = t.rlike("^[a-z]")
    end = ~F.substring(t, -1, 1).isin(".", "!", "?", ":", ";", '"', ")")
    pct = lambda c: F.round(100.0 * F.avg(c.cast("int")), 4)
    return chunks.agg(F.count("*").alias("n"), pct(start).alias("broken_start"), pct(end).alias("broken_end"), pct(~start & ~end).alias("clean"))


def chunk_stats(chunks: DataFrame, text_col: str = "text", limit: int = MAXIMUM) -> DataFrame:
    """Count, total, mean, median and greatest length, and chunks over the limit."""
    n = F.length(text_col)
    return chunks.agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 4).alias("mean"), F.round(F.median(n), 4).alias("median"), F.max(n).cast("bigint").alias("max"), F.count_if(n > limit).alias("over_limit"))


def windows(x: Column, width: int = 160) -> Column:
    """Three windows of a text at 30, 50 and 70 percent, clamped; a short text is its own."""
    n = F.length(x)
    three = F.transform(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7)), lambda f: F.substr(x, F.least((n * f).cast("int"), n - width) + 1, F.lit(width)))
    return F.when(n <= width, F.array(x)).otherwise(F.array_distinct(three))


def browse(df: DataFrame, id_col: str, text_col: str, where: Column | None = None, grep: str | None = None, shuffle: int | None = None, skip: int = 0, limit: int = 20, around: int = 60) -> DataFrame:
    """A page of texts: ``id, head, tail``, and ``hit`` with ``around`` characters each side of the first match of ``grep``.

    Rows are in order of id, or of a hash that ``shuffle`` seeds, which is a repeatable random order.
    """
    rows = df if where is None else df.where(where)
    t = F.col(text_col)
    hit = F.lit(None).cast("string")
    if grep is not None:
        rows = rows.where(F.rlike(t, F.lit(grep)))
        at = F.locate("\x01", F.regexp_replace(t, f"(?s)^(.*?)({grep}).*$", "$1\x01"))
        hit = F.substr(t, F.greatest(at - around, F.lit(1)), F.lit(2 * around))
    order = F.col(id_col) if shuffle is None else F.xxhash64(F.lit(shuffle), F.col(id_col))
    picked = rows.orderBy(order, id_col).offset(skip).limit(limit)
    return picked.select(id_col, F.left(text_col, F.lit(80)).alias("head"), F.right(text_col, F.lit(40)).alias("tail"), hit.alias("hit"))
