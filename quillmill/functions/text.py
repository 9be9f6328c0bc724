"""Scalar functions as Column expressions: all native, so they stay in code generation where Spark has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token of the default counter is a run of ASCII letters and digits, one Chinese sign, or one other sign.
TOKEN = r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]|[^\sA-Za-z0-9]"
#: First words of headings that are call-outs and so no section boundary.
CALLOUTS = ("TIP", "CRUX", "ASIDE", "WARNING", "CAUTION", "SIDEBAR")
#: A sentence ends at .!? before white space and a capital or digit, or at a Chinese stop.
SENTENCE_END = r"(?<=[.!?])(?U:\s)+(?=[A-Z]|(?U:\d))|(?<=[。！？])"
#: The same without the condition on what follows, as overlaps use it.
LOOSE_END = r"(?<=[.!?])(?U:\s)+|(?<=[。！？])"
#: Fixed value: how a caption begins.
CAPTION = r"^(Figure|Table|图|表)\s*\d+(\.\d+)*\s*[:：\s]"
#: How code fences, table rows, formulas and figures of markdown are told.
FENCE, FENCE_OPENS, FENCE_CLOSES = "```", r"^```[^\n]*\n?", r"\n?```$"
LINE_END, ROW = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", r"^\|[^\n]+\|$"
MATH, IMAGE = "$$", "!["
#: Tags at the end of an answer.
CALCULATED, CITED = "[calculated]", "[sources: "


def token_count(text: Column) -> Column:
    """0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.lit(0))


def stripped(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def sentences(text: Column, boundary: str = SENTENCE_END) -> Column:
    """Parts between boundaries, without blank ones."""
    return F.filter(F.split(text, boundary), lambda s: stripped(s) != "")


def last_sentence(text: Column) -> Column:
    """stripped; the whole text if it has no sentence."""
    return F.coalesce(stripped(F.try_element_at(sentences(text), F.lit(-1))), stripped(text))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value computed once, however often the expression names it."""
    return F.transform(F.array(value), of)[0]


def greedy_pack(sizes: Column, most: int) -> Column:
    """Array of (first, last) positions, from 0: items are taken until the next one would exceed most; a first item that
    does so alone stays alone."""
    pairs = "array<struct<first:int,last:int>>"
    start = F.struct(F.array().cast(pairs).alias("packs"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("sum"))
    closed = lambda acc: F.concat(acc["packs"], F.array(F.struct(acc["first"].alias("first"), (acc["at"] - 1).alias("last"))))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["at"] > acc["first"]) & (acc["sum"] + size > most)
        return F.struct(
            F.when(full, closed(acc)).otherwise(acc["packs"]).alias("packs"),
            F.when(full, acc["at"]).otherwise(acc["first"]).alias("first"),
            (acc["at"] + 1).alias("at"),
            (F.when(full, F.lit(0).cast("bigint")).otherwise(acc["sum"]) + size).cast("bigint").alias("sum"),
        )

    return F.aggregate(sizes, start, step, lambda acc: F.when(acc["at"] > acc["first"], closed(acc)).otherwise(acc["packs"]))


def joined(items: Column, pack: Column, joiner: str = " ") -> Column:
    """The items of a pack of greedy_pack as one text."""
    return F.array_join(F.slice(items, pack["first"] + 1, pack["last"] - pack["first"] + 1), joiner)


def packed(items: Column, most: int, longer: Callable[[Column], Column] | None = None) -> Column:
    """Items joined by the packs of their token counts, each counted once; longer gives the parts of an item over the limit,
    which is always a pack of its own."""

    def of(items: Column, sizes: Column) -> Column:
        packs = greedy_pack(sizes, most)
        if longer is None:
            return F.transform(packs, lambda p: joined(items, p))
        fits = lambda p: (p["last"] > p["first"]) | (F.get(sizes, p["first"]) <= most)
        return F.flatten(F.transform(packs, lambda p: F.when(fits(p), F.array(joined(items, p))).otherwise(longer(F.get(items, p["first"])))))

    return bound(items, lambda i: bound(F.transform(i, token_count), lambda sizes: of(i, sizes)))


def split_long_text(text: Column, most: int) -> Column:
    """Sentences packed; what is still too long is packed by words, and what still is is cut by tokens."""

    def cut(word: Column) -> Column:
        starts = lambda tokens: F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / most).cast("int"))
        pieces = lambda tokens: F.transform(starts(tokens), lambda k: F.array_join(F.slice(tokens, k * most + 1, most), ""))
        return bound(F.regexp_extract_all(word, F.lit(TOKEN), F.lit(0)), pieces)

    def by_word(sentence: Column) -> Column:
        return packed(F.filter(F.split(sentence, r"(?U)\s+"), lambda w: w != ""), most, cut)

    parts = bound(packed(sentences(text), most, by_word), lambda p: F.when(F.size(p) == 0, F.array(text)).otherwise(p))
    return F.when(token_count(text) <= most, F.array(text)).otherwise(parts)


def overlap_suffix(text: Column, most: int) -> Column:
    """The last whole sentences within most tokens; without one, the last tokens."""
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("sum"), F.lit(False).alias("stop"))

    def step(acc: Column, s: Column) -> Column:
        n = token_count(s)
        stop = acc["stop"] | (acc["sum"] + n > most)
        return F.struct(F.when(stop, acc["taken"]).otherwise(F.concat(F.array(s), acc["taken"])).alias("taken"), F.when(stop, acc["sum"]).otherwise(acc["sum"] + n).alias("sum"), stop.alias("stop"))

    taken = F.aggregate(F.reverse(sentences(text, LOOSE_END)), start, step, lambda acc: acc["taken"])
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    tail = F.when(F.size(tokens) < most, text).otherwise(F.array_join(F.slice(tokens, F.size(tokens) - most + 1, most), ""))
    return F.when(F.size(taken) > 0, F.array_join(taken, " ")).otherwise(tail)


def is_heading_boundary(content: Column) -> Column:
    """P05."""
    return stripped(content).rlike(rf"(?i)^#{{1,6}}\s(?!(?:{'|'.join(CALLOUTS)})\b)")


def is_caption(content: Column) -> Column:
    """P06."""
    return content.rlike(CAPTION)


def classify_block(block: Column) -> Column:
    """Struct (type, content); the first rule that fits decides."""
    b = stripped(block)
    code = b.startswith(FENCE)  # whether it is closed or not
    inner = stripped(F.regexp_replace(F.regexp_replace(b, FENCE_OPENS, ""), FENCE_CLOSES, ""))
    formula = b.startswith(MATH) & b.endswith(MATH) & (F.length(b) > 4)
    table = F.exists(F.split(b, LINE_END), lambda line: stripped(line).rlike(ROW))
    kind = F.when(code, "code").when(formula, "formula").when(table, "table").when(b.startswith(IMAGE), "figure").otherwise("text")
    return F.struct(kind.alias("type"), F.when(code, inner).when(formula, stripped(F.substring(b, F.lit(3), F.length(b) - 4))).otherwise(b).alias("content"))


def strip_page_artifact(section: Column) -> Column:
    """E03."""
    return F.regexp_replace(section, r"\n\n\{\d+\}\s*$", "")


def format_timestamp(seconds: Column) -> Column:
    """H:MM:SS, cut off. Times count from the start of a recording; a negative one has no defined form."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)


def format_citation(file: Column, page_start: Column, page_end: Column, start_sec: Column, end_sec: Column) -> Column:
    """pages, else times, else the file."""
    pages = F.when(page_end.isNotNull() & (page_end != page_start), F.concat(file, F.lit(" p."), page_start, F.lit("-"), page_end)).otherwise(F.concat(file, F.lit(" p."), page_start))
    times = F.concat(file, F.lit(" "), format_timestamp(start_sec), F.when(end_sec.isNotNull(), F.concat(F.lit("-"), format_timestamp(end_sec))).otherwise(F.lit("")))
    return F.when(page_start.isNotNull(), pages).when(start_sec.isNotNull(), times).otherwise(file)


def normalize_text(x: Column) -> Column:
    """F03."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def keywords(question: Column) -> Column:
    """the first five words of more than one sign."""
    return F.slice(F.filter(F.split(question, r"\s+"), lambda w: F.length(w) > 1), 1, 5)


def has_cjk(x: Column) -> Column:
    """F06."""
    return x.rlike(r"[\x{4e00}-\x{9fff}]")


def mmss_to_sec(x: Column) -> Column:
    """mm:ss or h:mm:ss."""
    return F.aggregate(F.split(x, ":"), F.lit(0), lambda acc, p: acc * 60 + p.cast("int"))


def source_hints(location: Column) -> Column:
    """array of (kind, file, first, last, title), one for each part between full-width semicolons.

    audio: file and mm:ss-mm:ss; page: file and p.N or p.N-M; section: a title between corner brackets; none: '-' or
    empty; what else there is is unparsed."""

    def one(part: Column) -> Column:
        p = F.trim(part)
        get = lambda pattern, k: F.nullif(F.regexp_extract(p, pattern, k), F.lit(""))
        audio, page, section = r"^(\S+\.(?:mp3|wav|m4a)) (\d+:\d\d)-(\d+:\d\d)$", r"^(\S+\.\w+) p\.(\d+)(?:-(\d+))?$", r"^(\S+\.\w+)? ?「(.+)」$"
        kind = F.when(p.isin("", "-"), "none").when(p.rlike(audio), "audio").when(p.rlike(page), "page").when(p.rlike(section), "section").otherwise("unparsed")
        first = F.when(kind == "audio", mmss_to_sec(get(audio, 2))).when(kind == "page", get(page, 2).cast("int"))
        last = F.when(kind == "audio", mmss_to_sec(get(audio, 3))).when(kind == "page", F.coalesce(get(page, 3), get(page, 2)).cast("int"))
        return F.struct(kind.alias("kind"), F.coalesce(get(audio, 1), get(page, 1), get(section, 1)).alias("file"), first.alias("first"), last.alias("last"), get(section, 2).alias("title"))

    return F.transform(F.split(F.coalesce(location, F.lit("")), "；"), one)


def page_tag(page: Column) -> Column:
    return F.when(page.isNull(), F.lit("pNone")).otherwise(F.format_string("p%04d", page.cast("int")))


def chunk_id(book: Column, file: Column, page: Column, seq: Column) -> Column:
    """C12."""
    return F.concat_ws("/", book, file, page_tag(page), F.format_string("%04d", seq.cast("int")))


def parse_chunk_id(x: Column) -> Column:
    """struct (book_id, source_file, page, seq); nulls if it is no such id."""
    p = r"^([^/]+)/(.+)/p(None|\d{4,})/(\d{4,})$"
    get = lambda k: F.nullif(F.regexp_extract(x, p, k), F.lit(""))
    return F.struct(get(1).alias("book_id"), get(2).alias("source_file"), F.when(get(3) != "None", get(3)).cast("int").alias("page"), get(4).cast("int").alias("seq"))


def encode_collection(x: Column) -> Column:
    """F10."""
    return F.concat(F.lit("b_"), F.lower(F.hex(F.encode(x, "UTF-8"))))


def decode_collection(x: Column) -> Column:
    return F.decode(F.unhex(F.substring(x, F.lit(3), F.length(x))), "UTF-8")


def append_tool_tags(answer: Column, citations: Column, calculated: Column) -> Column:
    """what tools an answer used, a line each."""
    cited = F.when(F.size(citations) > 0, F.concat(F.lit(CITED), F.array_join(citations, ", "), F.lit("]")))
    return F.concat_ws("\n", answer, F.when(calculated, F.lit(CALCULATED)), cited)


def strip_known_tags(answer: Column) -> Column:
    """trailing lines of append_tool_tags, however many."""
    tag = r"(?:\[calculated\]|\[sources: [^\n]*)"
    return F.regexp_replace(F.regexp_replace(answer, rf"(?:\n{tag})+\s*$", ""), rf"^{tag}(?:\n{tag})*$", "")


def normalize_expression(x: Column) -> Column:
    """thousands commas, per cent signs and currency signs."""
    x = F.regexp_replace(x, r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    x = F.regexp_replace(x, r"(\d+(?:\.\d+)?)%", "($1/100)")
    return F.regexp_replace(x, r"[$€£¥]", "")


def base64_of(x: Column) -> Column:
    """F16: in one line; F.unbase64 reads it back."""
    return F.regexp_replace(F.base64(x), r"\s", "")


def alt_text(content: Column) -> Column:
    """F19."""
    return F.regexp_extract(content, r"^!\[([^\]]*)\]", 1)


def decode_baseline_source(x: Column) -> Column:
    """struct (file, page, start, end) of data/<file>:p<page from 0>@<offset> or data/<file>:t<start>-<end>."""
    paged, timed = r"^data/(.+):p(\d+)@\d+$", r"^data/(.+):t([\d.]+)-([\d.]+)$"
    get = lambda p, k: F.nullif(F.regexp_extract(x, p, k), F.lit(""))
    return F.struct(F.coalesce(get(paged, 1), get(timed, 1)).alias("file"), (get(paged, 2).cast("int") + 1).alias("page"), get(timed, 2).cast("double").alias("start"), get(timed, 3).cast("double").alias("end"))
