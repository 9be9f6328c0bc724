"""Conversation repair, ranked search and sentencepiece against plain versions that take other ways."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillmill.llm import conversations, lexical, pieces, queries

from ..conftest import SF
from .helpers import empty, odd, prose

MODEL = pieces.load_model(queries.PIECES)
TALK = "conv_id long, turn long, role string, text string"


# --- conversations ---


def cheapest(rows):
    """Dijkstra over (turns consumed, state), audits as the second key: (cost, audit, repaired)."""
    blank = lambda t: not any(c not in " \t\n\v\f\r" for c in t)
    seen, kinds = set(), []
    for role, text in rows:
        kinds.append("blank" if blank(text) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(" \t\n\v\f\r")[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out), Counter(kinds)
        if (i, state) in done:
            continue
        # States are left in order of cost, then audit; equal prefixes of other length can't tie as every edit of none is a turn.
        done.add((i, state))
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        heapq.heappush(heap, (cost + 3, audit + "I", i, due, (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 if kinds[i] else 0
                if role[:1] == due:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, due, (*out, rows[i])))
                else:
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, due, (*out, (name, text))))
                if role[:1] == "s" and state == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, "s", (*out, rows[i])))
    raise AssertionError("deleting all is always possible")


def all_audits(codes, i=0, state="", inserted=0):
    """Every audit with at most three insertions in a row, with its cost."""
    if i == len(codes) and state in ("", "a"):
        yield 0, ""
    due = "a" if state == "u" else "u"
    steps = [(3, "I", i, due, inserted + 1)] if inserted < 2 else []
    if i < len(codes):
        c, more = codes[i].lower(), 3 if codes[i].isupper() else 0
        steps.append((4, "D", i + 1, state, 0))
        if c != "x":
            steps.append((more, "K", i + 1, due, 0) if c == due else (more + 3, "R", i + 1, due, 0))
            if c == "s" and state == "":
                steps.append((more, "K", i + 1, "s", 0))
    for cost, edit, j, after, n in steps:
        for rest, tail in all_audits(codes, j, after, n):
            yield cost + rest, edit + tail


def test_audits_against_all_audits():
    rnd = random.Random(5)
    for _ in range(300):
        codes = "".join(rnd.choice("uaxsoUAS") for _ in range(rnd.randint(0, 5)))
        audit, state, cost = conversations.best(codes)
        assert (cost + conversations.FINAL[state], audit + conversations.TAIL[state]) == min(all_audits(codes))


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        a, b = (" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(f"{a}:{b}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def expected(rows):
    found = {}
    for conv, turns in damaged(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        said = [(r, t) for _, r, t in turns]
        numbers = {t for t, _, _ in turns if t is not None}
        cost, audit, text, kinds = cheapest(said)
        bad = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        found[conv] = (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], bad, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def talk(rnd, sizes):
    rows = []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = rnd.choice(["system", "tool", "", None, "uncle"]) if rnd.random() < 0.1 else ("user", "assistant")[turn % 2]
            text = rnd.choice([None, "", " \n", "the same.", "no end", "an end. \n"]) if rnd.random() < 0.3 else f"{prose(rnd, 6)} {rnd.choice(['.', '!', 'x'])}"
            rows.append((conv or None, turn * rnd.choice([1, 1, 2]) if rnd.random() < 0.97 else None, role, text))
    return rows


def report_of(spark, rows):
    d = conversations.damage(spark.createDataFrame(rows, TALK).withColumn("copies", F.lit("mine")).repartition(5))
    return {r[0]: tuple(r)[1:] for r in conversations.report(d, "conv", copies=F.col("copies")).collect()}


def test_whole_conversations(spark):
    rows = talk(random.Random(1), [0, 9, 1, 2, 3, 40, *[6] * 40])
    rows += rows[:5]  # repeated rows
    assert report_of(spark, rows) == expected(rows)


def test_long_conversations_in_blocks(spark, monkeypatch):
    rows = talk(random.Random(2), [3, 5, 160, 11, 12, 60, 8])
    rows += rows[40:60] * 3
    whole = expected(rows)
    assert report_of(spark, rows) == whole
    monkeypatch.setattr(conversations, "LONG", 10)
    monkeypatch.setattr(conversations, "BLOCK", 8)
    assert report_of(spark, rows) == whole
    d = conversations.damage(spark.createDataFrame(rows, TALK))
    parts = conversations.repair(d, "conv", copies=F.col("copies"))
    assert parts.filter("conv = 2").count() > 15
    again = {r[0]: tuple(r)[1:] for r in conversations.digests(parts, "conv").collect()}
    assert again == whole


def test_repair_gives_texts(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Are you there?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", " ")]
    got = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(rows, TALK)).collect()}
    assert got[1]["audit"] == "KIKK" and [tuple(t) for t in got[1]["turns"]] == [("user", "Hello."), ("assistant", ""), ("user", "Are you there?"), ("assistant", "Yes.")]
    assert got[2]["audit"] == "D" and got[2]["turns"] == [] and got[2]["blank"] == 1


def test_conversations_edges(spark):
    assert report_of(spark, [(7, None, "user", "Hi.")] * 2)[7][:3] == (0, 0, 1)
    none = spark.createDataFrame([], TALK)
    assert conversations.report(conversations.damage(none), "conv", copies=F.col("copies")).collect() == []
    dropped = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert report_of(spark, [(5, dropped, "user", "Hi.")]) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long = "word " * 300_000 + "end."
    assert report_of(spark, [(1, 1, "user", long), (1, 2, "assistant", "x" * 200_000 + " " * 200_000)])[1][5] == 3


# --- ranked search ---


def plain_terms(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if ord(c) > 127 or c.isalnum():
            run += c.lower() if ord(c) < 128 else c
        elif run:
            out.append(run)
            run = ""
    return out


def plain_search(docs, items, k=10):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * len(bags) // total
            s = sum(w[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(plain_terms(text)) if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(lexical, "ITEM_TERMS", 60)


def corpus(rnd):
    docs = [(k, prose(rnd, rnd.choice([3, 8, 8, 20, 90]))) for k in range(300)]
    docs += [(1000 + k, "One two, two ÉTÉ three42!") for k in range(120)]  # a hot stratum of copies
    docs += [(2000, None), (2001, ""), (2002, "?!"), (None, "One two"), (None, "One two"), (2003, "été One"), (2004, "rare " * 3000), (7, docs[7][1])]
    return docs


def search_rows(spark, docs, items):
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit(1)).repartition(6))
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    return sorted((tuple(r) for r in found.select("item", "rank", "doc", "score").collect()), key=repr)


def test_search_against_all_documents(spark, small_blocks):
    rnd = random.Random(3)
    docs = corpus(rnd)
    items = [(k, prose(rnd, 12)) for k in range(20)] + [(50, "two Three42 étÉ"), (50, "rare one"), (51, None), (52, "unheard of"), (None, "one"), (53, docs[7][1])]
    assert search_rows(spark, docs, items) == plain_search(docs, items)


def test_bounds_leave_blocks_out(spark, small_blocks):
    """Blocks whose bound is below the tenth score so far aren't visited, and none above it is left out."""
    rnd = random.Random(4)
    docs = [(k, prose(rnd, 200)) for k in range(200)] + [(900 + k, "quartz") for k in range(15)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"))
    dfs = lexical._frequencies(index, ["quartz", "bane"])
    q = lexical.Queries([["quartz", "bane"]], {t: lexical.weight(index.n_docs, n) for t, n in dfs.items()})
    least = lexical._seeds(index, q, 10)[0]
    best = []
    for batch in index.blocks.toArrow().combine_chunks().to_batches():
        for r in range(batch.num_rows):
            bound = int(lexical.bounds(q, batch, r)[0])
            (_, scores), *_ = lexical.scores(q, batch, r, lexical.np.array([0]))
            assert scores.max() <= bound
            best.append((bound, int(scores.max())))
    assert sum(b < least for b, _ in best) > 20
    assert all(s < least for b, s in best if b < least)


def test_search_edges(spark):
    index = lexical.build(odd(spark))
    found = lexical.search(index, spark.createDataFrame([(1, "same words"), (2, None)], "item_id long, text string")).collect()
    assert [(r["item"], r["rank"], r["doc"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1, 7), (1, 2, 7)]
    none = lexical.build(empty(spark))
    assert lexical.search(none, spark.createDataFrame([(1, "same words")], "item_id long, text string")).collect() == []
    assert lexical.search(index, spark.createDataFrame([], "item_id long, text string")).collect() == []


# --- sentencepiece ---


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def strings(n):
    rnd = random.Random(6)
    parts = ["a", "th", "e ", " ", "   ", "\n", "é", "中", "😀", "▁", "<0x0A>", "<s>", "\x00", "\t", "ing", " the", "12", "ß", "́", "퟿", "ar", "in", "er", "\U0010ffff"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16))) for _ in range(n)] + ["x" * 5000, "ab" * 4000 + " " * 3000, prose(rnd, 20_000), " ", ""]


def test_pieces_equal_the_library(library):
    table, encoder, decoder = pieces.PrefixTable(MODEL), pieces.Encoder(MODEL), pieces.Decoder(MODEL)
    many = strings(4000)
    for text, packed in zip(many, encoder.encode(many), strict=True):
        ids = library.encode(text)
        assert lexical.np.frombuffer(packed, "<u4").tolist() == ids, text
        assert decoder.decode(ids) == library.decode(ids)
        if text and len(text) < 100:  # whole, without cutting at blanks
            assert table.encode("▁" + text.replace(" ", "▁")) == ids
    rnd = random.Random(7)
    for _ in range(2000):  # ids that no text has, and bytes that are no UTF-8
        ids = [rnd.randrange(3, rnd.choice([259, 32_000])) for _ in range(rnd.randint(0, 8))]
        assert decoder.decode(ids) == library.decode(ids)


def test_table_holds_the_last_piece_of_each_prefix(library):
    table = pieces.PrefixTable(MODEL)
    text = "▁internationalisations"
    for end in range(1, len(text) + 1):
        assert table.pieces(text[:end])[-1] == library.id_to_piece(library.encode(text[1:end])[-1]) if end > 1 else "▁"


def test_pieces_that_go_on_into_blanks():
    scores = {s: -float(k) for k, s in enumerate(["a", "b", "▁", "a▁", "b▁a", "a▁b", "▁a"])}
    model = pieces.Model(scores, {s: k for k, s in enumerate(scores)}, tuple(range(100, 356)), True)
    table = pieces.PrefixTable(model)
    rnd = random.Random(8)
    for _ in range(500):
        text = "".join(rnd.choice("ab▁c") for _ in range(rnd.randint(1, 12)))
        assert table.pieces(text) == pieces.merged(text, scores)
    assert pieces.Encoder(model).words("a b") == ["▁a▁b"]


def test_pieces_tables(spark, library):
    d = odd(spark).withColumns({c: F.lit("mine") for c in ("n_tokens", "token_ids", "decoded", "key")})
    out = pieces.decode(pieces.encode(d, MODEL), MODEL)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert len(rows) == d.count()
    for r in rows:
        ids = library.encode(r["text"] or "")
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids) and r["key"] == "mine"
    assert pieces.encode(empty(spark), MODEL).collect() == []
    digests = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_sentencepiece(spark, SF).collect()}
    for doc, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "")
        assert digests[doc] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_conversation_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF).collect()}
    whole = expected(rows)
    for conv in {r[0] for r in rows} - set(whole):
        whole[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == whole
