"""One test for each rule of chunking, on element lists of our own."""

import pandas as pd

from quillmill.operators import chunking
from quillmill.operators.chunking import FileChunker


def element(kind, content, page=1):
    return {"type": kind, "content": content, "page_num": page}


def run(*elements, most=512, overlap=50):
    found, used = FileChunker(most, overlap).run(list(elements))
    names = ("seq", "element_type", "content", "token_count", "page_start", "page_end")
    out = [dict(zip(names, c, strict=True)) for c in found]
    assert all(c["seq"] < used for c in out)
    return [c | {"chunk_id": f"b/f.pdf/{'pNone' if c['page_start'] is None else 'p%04d' % c['page_start']}/{c['seq']:04d}"} for c in out]


def contents(*elements, **kw):
    return [c["content"] for c in run(*elements, **kw)]


def test_empty_and_short():
    assert run() == []
    (c,) = run(element("text", "One short text.", 3))
    assert c["chunk_id"] == "b/f.pdf/p0003/0000" and c["page_start"] == c["page_end"] == 3 and c["token_count"] == 4


def test_pages_join_in_a_chunk_and_zero_is_unknown():
    (c,) = run(element("text", "a", 1), element("text", "b", 2))
    assert (c["page_start"], c["page_end"], c["content"]) == (1, 2, "a b")
    (c,) = run(element("text", "a", 0))
    assert c["page_start"] is None and c["chunk_id"].split("/")[2] == "pNone"


def test_headings_and_breaks_end_a_chunk_and_go():
    assert contents(element("text", "a"), element("text", "## Next"), element("text", "b")) == ["a", "b"]
    assert contents(element("text", "a"), element("section_break", ""), element("text", "b")) == ["a", "b"]


def test_callouts_are_no_boundary():
    assert contents(element("text", "a"), element("text", "# tip: Do"), element("text", "b")) == ["a # tip: Do b"]
    assert contents(element("text", "a"), element("text", "# TIPS"), element("text", "b")) == ["a", "b"]


def test_each_atomic_type_stands_alone():
    for kind in chunking.ATOMIC:
        assert contents(element("text", "a"), element(kind, "x"), element("text", "b")) == ["a", "x", "b"]


def test_lead_in_moves_and_leaves_a_gap():
    out = run(element("text", "First one. Then see:"), element("table", "| a |"))
    assert [c["content"] for c in out] == ["First one.", "Then see: | a |"]
    out = run(element("text", "Then see:"), element("code", "x"))
    assert [c["content"] for c in out] == ["Then see: x"] and out[0]["chunk_id"].endswith("/0001")
    assert contents(element("text", "如下："), element("code", "x")) == ["如下： x"]


def test_caption_is_absorbed_but_a_mention_is_not():
    assert contents(element("figure", "![](a)"), element("text", "Figure 2.1: A cat"), element("text", "b")) == ["![](a) Figure 2.1: A cat", "b"]
    assert contents(element("figure", "![](a)"), element("text", "图 3：猫")) == ["![](a) 图 3：猫"]
    assert contents(element("figure", "![](a)"), element("text", "In Figure 2 we see")) == ["![](a)", "In Figure 2 we see"]


def test_split_table_merges_only_without_rule():
    assert contents(element("table", "| a | b |"), element("table", "-|-\n| 1 | 2 |"), element("text", "Table 1: x")) == ["| a | b |\n-|-\n| 1 | 2 | Table 1: x"]
    full = "| a |\n|---|\n| 1 |"
    assert contents(element("table", full), element("table", full)) == [full, full]
    assert contents(element("table", "| a |"), element("table", "|---|\n| 1 |")) == ["| a |", "|---|\n| 1 |"]


def test_only_parts_of_a_long_element_overlap():
    text = " ".join(f"Sentence number {k} is here." for k in range(20))
    parts = contents(element("text", text), most=20, overlap=6)
    assert len(parts) > 3 and all(b.startswith(a.split(". ")[-1]) for a, b in zip(parts, parts[1:], strict=False))
    plain = contents(element("text", "a b c d"), element("text", "e f g h"), most=6, overlap=4)
    assert plain == ["a b c d", "e f g h"]


def test_words_and_hard_cuts():
    assert chunking._split("a b c d e", 2, chunking.default_count) == ["a b", "c d", "e"]
    assert chunking._split("a.b.c.d", 3, chunking.default_count) == ["a.b", ".c.", "d"]


def test_spark_chunker_equals_native_without_triggers(spark):
    rows = [("b", f"f{f}", k, "text", ("# head" if k % 7 == 3 else f"Some words {k} of file {f}. More."), k // 5) for f in range(5) for k in range(30)]
    df = spark.createDataFrame(rows, "book_id string, source_file string, elem_idx int, type string, content string, page_num int")
    a = chunking.chunk_elements(df, 30, 5).toPandas().sort_values("chunk_id").reset_index(drop=True)
    b = chunking.chunk_elements_native(df, 30).toPandas().sort_values("chunk_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_invariants_hold_on_all_chunks(spark):
    from quillmill.plans.chunks import document_elements

    from .conftest import SF

    chunks = chunking.chunk_elements(document_elements(spark, SF))
    found = {r["rule"] for r in chunking.chunk_quality_violations(chunks).collect()}
    assert found <= {"micro chunk"}


def test_segments(spark):
    s = [("b", "f", 0, " Hello there ", 0.0, 1.0, 0.2, "A"), ("b", "f", 1, "", 1.0, 2.0, None, "A"), ("b", "f", 2, "again you", 2.0, 3.0, 0.9, "A"), ("b", "f", 3, "yes I do now", 3.0, 4.0, None, "B"), ("b", "g", 0, "x", 0.0, 1.0, 0.1, None)]
    df = spark.createDataFrame(s, "book_id string, source_file string, seg_idx int, text string, start double, end double, score double, speaker string")
    out = {r["chunk_id"]: r for r in chunking.pack_segments(df, 4).collect()}
    assert out["b/f/0000"]["content"] == "[A] Hello there again you" and out["b/f/0000"]["end_sec"] == 3.0 and out["b/f/0000"]["low_confidence"]
    assert out["b/f/0001"]["content"] == "[B] yes I do now" and out["b/f/0001"]["score"] == 1.0
    assert out["b/g/0000"]["content"] == "x" and out["b/g/0000"]["low_confidence"]


def test_sections_of_a_file_are_chunked_apart_and_numbered_together(spark):
    """Random files, cut at their headings and breaks, have the chunks and numbers of whole files."""
    import random

    rnd = random.Random(7)
    made = [("text", "## A heading"), ("section_break", ""), ("text", "Some plain words here."), ("text", "See the following:"), ("table", "| a | b |"), ("table", "- | - |\n| 1 | 2 |"), ("figure", "![x](y.png)"), ("text", "Figure 1.2: A caption"), ("text", "One. Two three four. Five six! Seven eight nine ten? Eleven."), ("code", "```x```"), ("text", "")]
    rows, want = [], {}
    for file in ("f.pdf", "g.pdf", None):
        elements = [rnd.choice(made) for _ in range(120)]
        rows += [("b", file, k, kind, content, k // 9) for k, (kind, content) in enumerate(elements)]
        for c in FileChunker(12, 4).run([element(kind, content, k // 9) for k, (kind, content) in enumerate(elements)])[0]:
            seq, kind, content, tokens, first, last = c
            page = "pNone" if not first else f"p{first:04d}"
            want[f"b/{file}/{page}/{seq:04d}"] = (file, kind, content, tokens, first, last)
    df = spark.createDataFrame(rows, "book_id string, source_file string, elem_idx int, type string, content string, page_num int").repartition(7)
    got = {r.chunk_id: tuple(r)[2:] for r in chunking.chunk_elements(df, 12, 4).collect()}
    assert got == want
    parts = chunking.sections(df).groupBy("source_file").agg({"section": "max"}).collect()
    assert all(r[1] > 10 for r in parts)
