"""Token-bounded chunks of ordered elements and of timed segments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import CALLOUTS, CAPTION, LOOSE_END, SENTENCE_END, TOKEN, chunk_id, greedy_pack, is_heading_boundary, split_long_text, stripped, token_count
from quillmill.sources.scratch import release, scratch_dir
from quillmill.sources.store import same

MAX_TOKENS, OVERLAP_TOKENS, SEGMENT_TOKENS, LOW_CONFIDENCE = 512, 50, 256, 0.6
ATOMIC = ("table", "formula", "code", "figure")
CHUNKS = "chunk_id string, book_id string, source_file string, element_type string, content string, token_count int, page_start int, page_end int"


# --- native parts -----------------------------------------------------------------------------------------------------


def section_groups(elements: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds group_id; headings and section breaks end a group and are dropped, an atomic element is its own group."""
    by = by or ["doc"]
    boundary = ((F.col("type") == "text") & is_heading_boundary(F.col("content"))) | (F.col("type") == "section_break")
    atomic = F.col("type").isin(*ATOMIC)
    w = Window.partitionBy(*by).orderBy("elem_idx")
    marked = elements.withColumn("_b", boundary).withColumn("_a", atomic)
    starts = F.col("_b") | F.col("_a") | F.coalesce(F.lag("_a").over(w), F.lit(False))
    grouped = marked.withColumn("group_id", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.filter("NOT _b").drop("_b", "_a")


def page_span(by: list[str], elements: DataFrame) -> DataFrame:
    """C11: first and last page of the members of a group, 0 as null."""
    first, last = F.min_by("page_num", "elem_idx"), F.max_by("page_num", "elem_idx")
    return elements.groupBy(*by).agg(F.nullif(first, F.lit(0)).alias("page_start"), F.nullif(last, F.lit(0)).alias("page_end"))


def chunk_seq(df: DataFrame, by: list[str], order: list[str], offset: int = 0) -> DataFrame:
    """Adds seq, from offset."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + offset)


def chunk_texts(docs: DataFrame, key: str, text: str, most: int = MAX_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The native path for files that are one text each: sentences packed to at most `most` tokens, with sequence and count;
    columns in keep go along."""
    parts = docs.select(key, *keep, F.posexplode(split_long_text(F.col(text), most)).alias("seq", "content"))
    return parts.withColumn("token_count", token_count(F.col("content")))


def chunk_elements_native(elements: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """C13 for files without lead-ins, split tables, captions and elements over the limit: windows and packs only."""
    by = ["book_id", "source_file"]
    grouped = section_groups(elements, by)
    member = F.struct("elem_idx", "type", "content", "page_num")
    packs = grouped.groupBy(*by, "group_id").agg(F.array_sort(F.collect_list(member)).alias("m"))  # as long as a section
    packs = packs.select(*by, "group_id", "m", F.posexplode(greedy_pack(F.transform("m", lambda x: token_count(x["content"])), most)).alias("k", "p"))
    part = F.slice("m", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1)
    out = packs.select(*by, "group_id", "k", F.array_join(F.transform(part, lambda x: x["content"]), " ").alias("content"), part.alias("m"))
    out = chunk_seq(out.withColumn("content", F.trim("content")).filter("content <> ''"), by, ["group_id", "k"])
    first, last = F.nullif(F.element_at("m", 1)["page_num"], F.lit(0)), F.nullif(F.element_at("m", -1)["page_num"], F.lit(0))
    return out.select(
        chunk_id(F.col("book_id"), F.col("source_file"), first, F.col("seq")).alias("chunk_id"), *by, F.element_at("m", 1)["type"].alias("element_type"), "content",
        token_count(F.col("content")).alias("token_count"), first.alias("page_start"), last.alias("page_end"),
    )


# --- one section at a time --------------------------------------------------------------------------------------------

_TOKEN = re.compile(TOKEN.replace(r"\x{4e00}-\x{9fff}", "一-鿿"))
_END = re.compile(SENTENCE_END.replace("(?U:\\s)", "\\s").replace("(?U:\\d)", "\\d"))
_LOOSE = re.compile(LOOSE_END.replace("(?U:\\s)", "\\s"))
_HEADING = re.compile(rf"#{{1,6}}\s(?!(?:{'|'.join(CALLOUTS)})\b)", re.I)
_CAPTION = re.compile(CAPTION)
#: Fixed value: the line below a table's head.
_RULE = re.compile(r"\|[-\s]*-{2,}[-:\s]*\|")


def default_count(text: str) -> int:
    return len(_TOKEN.findall(text))


def _sentences(text: str, end=_END) -> list[str]:
    return [s for s in end.split(text) if s.strip()]


def _pack(items: list[str], most: int, count) -> list[str]:
    out, now, size = [], [], 0
    for item in items:
        n = count(item)
        if now and size + n > most:
            out.append(" ".join(now))
            now, size = [], 0
        now.append(item)
        size += n
    return out + ([" ".join(now)] if now else [])


def _split(text: str, most: int, count) -> list[str]:
    """C04."""
    if count(text) <= most:
        return [text]
    pieces = [q for p in _pack(_sentences(text), most, count) for q in ([p] if count(p) <= most else _pack(p.split(), most, count))]
    out = []
    for p in pieces:
        tokens = _TOKEN.findall(p)
        out += [p] if count(p) <= most else ["".join(tokens[i : i + most]) for i in range(0, len(tokens), most)]
    return out or [text]


def _suffix(text: str, most: int, count) -> str:
    """C05."""
    taken: list[str] = []
    for s in reversed(_sentences(text, _LOOSE)):
        if count(" ".join(taken)) + count(s) > most:
            break
        taken.insert(0, s)
    tokens = _TOKEN.findall(text)
    return " ".join(taken) or (text if len(tokens) < most else "".join(tokens[-most:]))


class FileChunker:
    """The elements of a section (or of a whole file), in order, to chunks: (seq, type, content, tokens, first and last page) of
    each, and how many numbers they use. Plain texts gather in a buffer; an atomic element takes along what
    belongs to it: the sentence that leads to it, the rest of a split table, its caption."""

    def __init__(self, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] = default_count):
        self.most, self.overlap, self.count = most, overlap, count

    def run(self, elements: list[dict]) -> tuple[list[tuple], int]:
        self.out, self.seq, self.waiting = [], 0, []
        rest = list(reversed(elements))
        while rest:
            e = rest.pop()
            if e["type"] == "section_break" or (e["type"] == "text" and _HEADING.match(e["content"].strip())):
                self.flush()
            elif e["type"] in ATOMIC:
                self.atomic(e, rest)
            elif self.count(e["content"]) > self.most:
                self.flush()
                self.oversize(e)
            else:
                if self.waiting and sum(self.count(w["content"]) for w in self.waiting) + self.count(e["content"]) > self.most:
                    self.flush()
                self.waiting.append(e)
        self.flush()
        return [tuple(c.values()) for c in self.out], self.seq

    def emit(self, kind: str, content: str, members: list[dict]) -> None:
        content = content.strip()
        if not content:
            return
        first, last = members[0]["page_num"] or None, members[-1]["page_num"] or None
        self.out.append({"seq": self.seq, "element_type": kind, "content": content, "token_count": self.count(content), "page_start": first, "page_end": last})
        self.seq += 1

    def flush(self) -> bool:
        if not self.waiting:
            return False
        self.emit("text", " ".join(w["content"] for w in self.waiting), self.waiting)
        self.waiting = []
        return True

    def oversize(self, e: dict) -> None:
        """Only the parts of one long element overlap; plain chunks never do."""
        before = ""
        for part in _split(e["content"], max(1, self.most - self.overlap), self.count):
            self.emit("text", before + part, [e])
            before = _suffix(part, self.overlap, self.count) + " "

    def lead_in(self) -> str:
        """Takes the last sentence, if it ends in a colon, off the last chunk; the chunk shrinks or goes, its number stays used."""
        last = self.out[-1] if self.out else None
        if not last or last["element_type"] != "text":
            return ""
        parts = _sentences(last["content"])
        sentence = parts[-1].strip() if parts else last["content"]
        if not sentence.endswith((":", "：")):
            return ""
        last["content"] = last["content"][: last["content"].rfind(sentence)].strip()
        last["token_count"] = self.count(last["content"])
        if not last["content"]:
            self.out.pop()
        return sentence

    def atomic(self, e: dict, rest: list[dict]) -> None:
        lead = self.lead_in() if self.flush() else ""
        members, content = [e], e["content"]
        if e["type"] == "table" and not _RULE.search(content) and rest and rest[-1]["type"] == "table" and rest[-1]["content"].lstrip().startswith("-"):
            members.append(rest.pop())  # C09
            content = content.rstrip() + "\n" + members[-1]["content"]
        caption = ""
        if rest and rest[-1]["type"] == "text" and _CAPTION.match(rest[-1]["content"]):
            members.append(rest.pop())  # C10
            caption = members[-1]["content"]
        self.emit(e["type"], " ".join(x for x in (lead, content, caption) if x), members)


def sections(elements: DataFrame) -> DataFrame:
    """Adds section, the number of headings and section breaks of the file so far: what a buffer of texts never crosses. A running
    sum over a file's rows in their order, which spills if it must; nothing is gathered."""
    boundary = (F.col("type") == "section_break") | ((F.col("type") == "text") & is_heading_boundary(F.col("content")))
    file = Window.partitionBy("book_id", "source_file").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("section", F.sum(F.when(boundary, 1).otherwise(0)).over(file))


def chunk_elements(elements: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] = default_count, root: str | None = None, portions: int = 1) -> DataFrame:
    """Elements (book_id, source_file, elem_idx, type, content, page_num) to chunks.

    Sections are independent: a boundary empties the buffer, and what an atomic element takes along stands in its own section. So
    sections are dealt out, one after the other in a task, whatever their file; their chunks are written to root (a folder of
    their own in the shared one, unless given), and numbers follow from how many the sections before have used. Files go in portions by their hash, and only one portion's shuffles are
    kept at a time; each reads the elements anew. Null types are text, null contents empty; files without
    name are one."""
    spark, root = elements.sparkSession, root or scratch_dir(elements.sparkSession, "chunks")
    key = ["book_id", "source_file", "section"]
    rows = elements.select("book_id", "source_file", "elem_idx", F.coalesce("type", F.lit("text")).alias("type"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce(F.col("page_num").cast("int"), F.lit(0)).alias("page_num"))
    of = F.pmod(F.xxhash64("book_id", "source_file"), F.lit(portions))
    dealt = lambda some: sections(some).repartition(*key).sortWithinPartitions(*key, "elem_idx").select(*key, "type", "content", "page_num")
    columns = [*key, "used", "seq", "element_type", "content", "token_count", "page_start", "page_end"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunker, out = FileChunker(most, overlap, count), []
        rows = (r for f in frames for r in zip(*(f[c].tolist() for c in f.columns), strict=True))
        for (book, file, section), members in groupby(rows, lambda r: (r[0], r[1], int(r[2]))):
            found, used = chunker.run([{"type": t, "content": c, "page_num": p} for *_, t, c, p in members])
            out += [(book, file, section, used, *chunk) for chunk in found]
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=columns).astype({"page_start": "Int32", "page_end": "Int32"})
                out = []
        yield pd.DataFrame(out, columns=columns).astype({"page_start": "Int32", "page_end": "Int32", "section": "int64", "used": "int32", "seq": "int32", "token_count": "int32"})

    schema = "book_id string, source_file string, section long, used int, seq int, element_type string, content string, token_count int, page_start int, page_end int"
    for k in range(portions):
        made = dealt(rows.filter(of == k) if portions > 1 else rows).mapInPandas(run, schema)
        made.write.mode("append" if k else "overwrite").option("compression", "zstd").parquet(root)
        if portions > 1:
            release(spark)
    chunks = spark.read.schema(schema).parquet(root)
    before = Window.partitionBy("book_id", "source_file").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.groupBy(*key).agg(F.max("used").alias("used")).withColumn("offset", F.coalesce(F.sum("used").over(before), F.lit(0)))
    placed = chunks.alias("l").join(offsets.drop("used").alias("r").hint("merge"), same("l", "r", key)).select("l.*", "offset")
    name = lambda c: F.coalesce(F.col(c), F.lit("None"))
    number = F.col("seq") + F.col("offset").cast("int")
    return placed.select(chunk_id(name("book_id"), name("source_file"), F.col("page_start"), number).alias("chunk_id"), "book_id", "source_file", "element_type", "content", "token_count", "page_start", "page_end")


# --- timed segments ---------------------------------------------------------------------------------------------------


def pack_segments(segments: DataFrame, most: int = SEGMENT_TOKENS) -> DataFrame:
    """Segments (book_id, source_file, seg_idx, text, start, end, score, speaker) to chunks.

    Blank texts are left out. A speaker's name stands before the first of the speaker's segments in each chunk; the score
    is the mean weighted by tokens, 1.0 without tokens, and low below 0.6. The segments of one recording are one group."""
    by = ["book_id", "source_file"]
    s = segments.withColumn("text", stripped(F.col("text"))).filter("text <> ''").withColumn("tok", token_count(F.col("text")))
    member = F.struct("seg_idx", "text", "start", "end", F.coalesce("score", F.lit(1.0)).alias("score"), "speaker", "tok")
    packs = s.groupBy(*by).agg(F.array_sort(F.collect_list(member)).alias("m"))
    packs = packs.select(*by, "m", F.posexplode(greedy_pack(F.transform("m", lambda x: x["tok"]), most)).alias("seq", "p"))
    packs = packs.withColumn("m", F.slice("m", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1))

    def tagged(x: Column, k: Column) -> Column:
        """Null speakers change nothing; the last named one before decides."""
        before = F.filter(F.slice("m", 1, k), lambda y: y["speaker"].isNotNull())
        last = F.try_element_at(before, F.lit(-1))["speaker"]
        return F.when(x["speaker"].isNotNull() & ~x["speaker"].eqNullSafe(last), F.concat(F.lit("["), x["speaker"], F.lit("] "), x["text"])).otherwise(x["text"])

    content = F.array_join(F.transform("m", tagged), " ")
    weight = F.aggregate("m", F.lit(0.0), lambda a, x: a + x["tok"])
    mean = F.coalesce(F.aggregate("m", F.lit(0.0), lambda a, x: a + x["score"] * x["tok"]) / F.nullif(weight, F.lit(0.0)), F.lit(1.0))
    return packs.select(
        F.concat_ws("/", *by, F.format_string("%04d", "seq")).alias("chunk_id"), *by, F.lit("audio").alias("element_type"), content.alias("content"), token_count(content).alias("token_count"),
        F.element_at("m", 1)["start"].alias("start_sec"), F.element_at("m", -1)["end"].alias("end_sec"), (mean < LOW_CONFIDENCE).alias("low_confidence"), mean.alias("score"),
    )


# --- checks -----------------------------------------------------------------------------------------------------------


def chunk_quality_violations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, rule), a row for each rule that a chunk breaks; repeated ids come once."""
    row = F.array_compact(F.array(
        F.when(F.trim("content").rlike(r"^\{\d+\}$"), "page artefact"), F.when(F.col("token_count") < 10, "micro chunk"), F.when(F.col("page_end") < F.col("page_start"), "page range"),
        F.when(F.col("token_count") != token_count(F.col("content")), "token count"), F.when(~F.col("chunk_id").rlike(r"^[^/]+/.+/p(None|\d{4,})/\d{4,}$"), "malformed id"),
    ))
    broken = chunks.select("chunk_id", F.explode(row).alias("rule"))
    twice = chunks.groupBy("chunk_id").count().filter("count > 1").select("chunk_id", F.lit("duplicate id").alias("rule"))
    return broken.union(twice)


