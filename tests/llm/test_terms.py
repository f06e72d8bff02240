"""Chat formatting, source divergence and lexical search against brute force, on small tables with every odd case."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import chat, divergence, lexical, terms
from shelfspark.llm.common import written

WORDS = "the of and to in that it is was for on are as with they at be this from or one had by word but not".split()
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS_DIGITS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _texts():
    rng = random.Random(9)
    out = [None, "", "  ", "12 34", "Äpfel ÄPFEL äpfel", "日本語 text 日本語", "a" * 70 + " " + "b" * 17 + " " + "é" * 40, "w" * 5000 + "v", "x\x00y K K k"]
    for _ in range(80):
        out.append(" ".join(rng.choice(WORDS) * rng.choice([1, 1, 1, 2, 5]) + rng.choice(["", "", "é", "9", "Q"]) for _ in range(rng.randint(1, 90))))
    return out + out[20:24] + ["the " * 3000 + "of " * 70]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 30 else None, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", "s2", None][i % 5]) for i, t in enumerate(TEXTS)]
    rows += [(8, "", "de", "s0"), (9, None, "de", "s1"), rows[40]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(
        {"term": F.lit("t"), "n": F.lit(1), "rank": F.lit("r"), "score": F.lit(2), "item": F.lit(0), "part": F.lit("p"), "per": F.lit(3)}).repartition(4)


def test_terms_match_the_pattern():
    for kind, pattern in ((terms.LETTERS, LETTERS), (terms.LETTERS_DIGITS, LETTERS_DIGITS)):
        for column in (pa.array(TEXTS), pa.chunked_array([pa.array(TEXTS[:5]), pa.array(TEXTS[5:])]), pa.array(TEXTS).slice(3, 20)):
            data, offsets = terms.text_bytes(column)
            starts, lengths, rows = terms.find_terms(data, offsets, kind)
            got = [(r, data[s : s + n].tobytes().decode()) for s, n, r in zip(starts, lengths, rows)]
            assert got == [(i, w) for i, t in enumerate(column.to_pylist()) for w in pattern.findall(_lower(t))]
            same = collections.defaultdict(set)
            for h, (_, w) in zip(terms.hashes(data, starts, lengths), got):
                same[int(h)].add(w)
            assert all(len(v) == 1 for v in same.values()) and len(same) == len({w for _, w in got})


def test_radix_order_is_stable_and_total():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & np.uint64(0xFF00FF0000FF00FF)
    assert list(terms.radix_order(terms.digits_of(words, 8))) == list(np.argsort(words, kind="stable"))
    assert list(terms.radix_order([np.zeros(3, dtype=np.uint16)])) == [0, 1, 2]


def _audit(docs, min_docs, top):
    counts, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in docs:
        words = LETTERS.findall(_lower(text))
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        p = {}
        for (other, source), n in counts.items():
            if other == lang:
                total = sum(n[t] for t in kept) + len(kept)
                p[source] = {t: 1 + 10**9 * (n[t] + 1) // total for t in kept}
        whole = {t: sum(n[t] for (other, _), n in counts.items() if other == lang) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        for source in p:
            pairs = [(sum((p[source][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in p if o != source]
            best = [((p[source][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", best, top)):
                for rank, (value, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most], 1):
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("min_docs,top", [(3, 200), (1, 5), (1000, 3)])
def test_audit(docs, rows, min_docs, top):
    plain = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    got = rows(divergence.audit(docs, min_docs, top), "lang", "source", "part", "item", "value", "rank")
    assert got == _audit(plain, min_docs, top)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 3, "lang string, source string, text string")
    assert divergence.audit(nulls).count() == 0


def test_rates_are_exact_beyond_64_bits():
    counts, totals = np.array([0, 7, 10**14, 5 * 10**15]), np.array([1, 9, 3 * 10**14 + 1, 9 * 10**15])
    assert list(divergence.rates(counts, totals)) == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals)]


def test_matching_in_small_pieces(monkeypatch):
    rng = random.Random(5)
    table = [("en", f"w{i}", None, [{"source": f"s{j}", "n": rng.randint(1, 9)} for j in range(4) if rng.random() < 0.6]) for i in range(60)]
    table = [(a, b, sum(x["n"] for x in p), p) for a, b, _, p in table if p]
    kind = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("per", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in table[a : a + 9]], schema=kind) for a in range(0, len(table), 9)]

    def run():
        make = lambda: divergence._Matcher({"en": {f"s{j}": j for j in range(4)}}, {"en": np.array([300] * 4)}, {"en": 1200}, 4)
        return sorted(tuple(r.values()) for b in divergence._match(iter(batches), make) for r in b.to_pylist())

    whole = run()
    monkeypatch.setattr(divergence, "CELLS", 8)
    monkeypatch.setattr(divergence, "BATCH_BYTES", 1)
    assert run() == whole and len(whole) > 12


def _search(docs, items, k=50):
    found = [(i, collections.Counter(LETTERS_DIGITS.findall(_lower(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(w for _, c in found for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(LETTERS_DIGITS.findall(_lower(t)))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in found:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "the of WORD9 and"), (2, "nothing-here zzz"), (3, None), (4, " ".join(WORDS) + " äpfel " + "w" * 5000 + "v"), (4, "日本語"), (None, "12 the"), (5, "the the the")]


@pytest.mark.parametrize("k", [1, 50])
def test_search(spark, docs, k):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"doc_id": F.lit(1), "rank": F.lit(2), "term": F.lit(0)})
    got = lexical.search(written(lexical.build_index(docs), "signatures"), items, k)
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _search(plain, ITEMS, k)


def test_search_of_nothing(spark, docs):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(written(lexical.build_index(no_docs), "signatures"), items).count() == 0
    assert lexical.search(written(lexical.build_index(docs), "signatures"), no_items).count() == 0


def test_search_in_small_blocks_leaves_documents_out(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "BLOCK_ENTRIES", 400)
    monkeypatch.setattr(lexical, "GATHER", 900)
    monkeypatch.setattr(lexical, "CELLS", 512)
    monkeypatch.setattr(lexical, "BATCH_BYTES", 2000)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(rng.randint(1, 120))) for _ in range(600)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(a, a + 20)), "text": texts[a : a + 20]}) for a in range(0, 600, 20)]
    blocks = list(lexical._index_batches(iter(batches)))
    assert len(blocks) > 20
    asked = lexical._Asked([(i, h) for i, t in ((1, "the7 of3 and"), (2, "word9 not of3 but the"))
                            for h in terms.hashes(*(lambda d, o: (d, *terms.find_terms(d, o, terms.LETTERS_DIGITS)[:2]))(*terms.text_bytes(pa.array([t])))).view(np.int64).tolist()])
    counts = collections.Counter()
    for row in next(lexical._statistics(iter(blocks), asked)).to_pylist():
        counts[row["place"]] += row["n"]
    asked.weigh(counts.pop(-1), counts.pop(-2), counts)
    scored = []
    exact = lexical._Block.scores
    monkeypatch.setattr(lexical._Block, "scores", lambda self, d: scored.append(len(d)) or exact(self, d))
    got = [tuple(r.values()) for b in lexical._search_batches(iter(blocks), asked, 5) for r in b.to_pylist()]
    want = _search(list(enumerate(texts)), [(1, "the7 of3 and"), (2, "word9 not of3 but the")], 5)
    assert sorted(got) == sorted((i, d, s) for i, _, d, s in want)
    assert sum(scored) < 500  # the others are provably too low


def test_search_memory_is_bounded(spark, tmp_path):
    import pyarrow.parquet as pq

    # one long document does not widen the signature of the short ones that are gathered with it
    texts = ["a b c"] * 1500 + [" ".join(f"t{i}" for i in range(30_000))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    blocks = [b.to_pylist()[0] for b in lexical._index_batches(iter([batch]))]
    assert sum(len(b["sizes"]) for b in blocks) == 8 * len(texts)
    assert all(b["n_bits"] * (len(b["sizes"]) // 8) <= lexical.BLOCK_BITS for b in blocks)
    # blocks are large rows: a row group holds few of them
    docs = spark.range(0, 90, 1, 1).select(F.col("id").alias("doc_id"), F.expr(
        "array_join(transform(sequence(1, 20000), i -> concat('w', hash(id, i))), ' ')").alias("text"))
    index = written(lexical.build_index(docs), "signatures", lexical.GROUPED)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) <= 2 * lexical.GROUP_BYTES


def _conversations():
    rng = random.Random(8)
    marks = ["<turn>", "<text>", "<more>", "</turn>", "\\", "<\\turn>", "</turn", "\\\\<", "😀", "\n", "plain words", "<"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "us<text>er", "\\"]), "".join(rng.choice(marks) for _ in range(rng.randint(0, 9))))
            for c in range(12) for t in range(rng.randint(1, 30))]
    rows += [(50, None, "assistant", "x"), (50, None, "assistant", None), (50, 0, None, "y"), (None, 3, "user", "z"), (None, 1, "assistant", ""), rows[5], rows[5]]
    rows += [(60, t, "assistant" if t % 7 else "user", "<more>" * (t % 3) + "😀" * (t % 5)) for t in range(2500)]
    return rows + [(61, 0, "assistant", "long \\ text <turn> " * 20000)]


@pytest.mark.parametrize("chunk", [3, 256])
def test_chat(spark, chunk):
    data = _conversations()
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns(
        {"part": F.lit("p"), "items": F.lit(1), "piece": F.lit(2), "formatted": F.lit(3), "n_turns": F.lit(4), "loss": F.lit(5)}).repartition(3)
    made = written(chat.format_conversations(rows, chunk=chunk), "chats")
    turns = {r.conv_id: [tuple(t) for t in r.t] for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(data, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert turns == want
    spans = {r.conv_id: (r.formatted, r.loss) for r in made.collect()}
    for row in chat.digests(made).collect():
        own = want[row.conv_id]
        learned = "".join(t for r, t in own if r == "assistant")
        assert row.n_turns == len(own)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        formatted, loss = spans[row.conv_id]
        assert row.formatted_chars == len(formatted)
        assert "".join(re.sub(r"(?s)\\(.)", r"\1", formatted[s.start : s.start + s.length]) for s in loss) == learned
        blocks = [r for i, (r, _) in enumerate(own) if not i or own[i - 1][0] != r]
        assert formatted.count("<turn>") == formatted.count("</turn>") == len(blocks)  # neighbours of one role are merged


def test_chat_other_template_and_nothing(spark):
    template = chat.Template("#role:", "#says:", "#and:", "#end.")
    rows = spark.createDataFrame([(1, 0, "user", "#end. #role:x\\#says:"), (1, 1, "assistant", "#and:"), (1, 2, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(rows, template).select("formatted", chat.read_turns(F.col("formatted"), template).alias("t")).first()
    assert [tuple(t) for t in row.t] == [("user", "#end. #role:x\\#says:"), ("assistant", "#and:"), ("assistant", "ok")]
    assert row.formatted == "#role:user#says:#\\end. #\\role:x\\\\#\\says:#end.#role:assistant#says:#\\and:#and:ok#end."
    assert chat.digests(chat.format_conversations(rows.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.Template("<a>", "<a>b", "<c>", "<d>")


def test_chat_runs_no_python(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_conversations(rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
