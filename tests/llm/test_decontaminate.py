import random
import tracemalloc

import numpy as np
import pyarrow as pa
from linkgrove.llm import decontaminate as dc


def brute_score(item, text, rule):
    """Best score of local alignment by the plain recurrence."""
    match, other = rule
    best = 0
    grid = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            step = match if a == b else other
            grid[i][j] = max(0, grid[i - 1][j - 1] + step, grid[i - 1][j] + other, grid[i][j - 1] + other)
            best = max(best, grid[i][j])
    return best


def test_alignment_scores():
    rng = random.Random(1)
    for turn in range(300):
        rule = (dc.LOOSE, dc.TIGHT)[turn % 2]
        item = np.array([rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))])
        text = np.array([rng.randrange(0, 6) for _ in range(rng.randrange(1, 30))])
        matches, score, first, last, start, end = dc.align(item, text, rule)
        assert score == brute_score(item.tolist(), text.tolist(), rule)
        assert matches <= min(last - first, end - start)
        # the score is that of an alignment of just these two ranges
        assert score == brute_score(item[first:last].tolist(), text[start:end].tolist(), rule)
        edits = (rule[0] * matches - score) / -rule[1]
        assert edits == int(edits) >= max(last - first, end - start) - matches


def test_every_copy_keeps_seeds():
    """No choice of edits within the similarity leaves fewer seeds than the bound."""
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randrange(dc.SEED, 60)
        q = dc.SHORT_SEED if n <= dc.SHORT else dc.SEED
        s = n if n <= dc.SHORT else rng.randrange(dc.least_span(n), n + 1)
        changed = rng.randrange(s // 5 + 1)
        added = rng.randrange(max(0, (s - changed) // 4 - changed) + 1)
        step = rng.randrange(1, 6)
        gone = {min(s - 1, k * step + q - 1) for k in range(changed)}
        text = [-1 if k in gone else k for k in range(s)]
        for k in range(added):
            text.insert(min(len(text), (k + 1) * step), -2)
        seeds = {tuple(range(k, k + q)) for k in range(s - q + 1)}
        left = seeds & {tuple(text[k : k + q]) for k in range(len(text) - q + 1)}
        assert len(left) >= dc.kept_seeds(n) or (s - len(gone)) < 4 * (len(gone) + added)


def edited(rng, ws, rate):
    out = []
    for w in ws:
        x = rng.random()
        if x < rate / 3:
            out.append("changed" + str(rng.randrange(99)))
        elif x < rate * 2 / 3:
            out += [w, "added" + str(rng.randrange(99))]
        elif x >= rate:
            out.append(w)
    return out


def test_planted_copies(spark):
    rng = random.Random(7)
    pool = [f"w{k}" for k in range(3000)] + ["the", "of", "in"] * 300
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(k, text(rng.randrange(15, 60))) for k in range(40)]
    docs, expect = [], set()
    for d in range(300):
        body = text(200)
        if d % 3 == 0:
            k, ws = items[d % 40]
            rate = rng.choice([0, 0.05, 0.12])
            at = rng.randrange(200)
            copy = edited(rng, ws, rate)
            body = body[:at] + [w.upper() + "," for w in copy] + body[at:]
            if rate < 0.06:
                expect.add((d, k))
        elif d % 3 == 1:
            ws = items[d % 40][1]
            body = body + ws[: len(ws) // 3]
        docs.append((d, " ".join(body)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(frame, bench).collect()}
    assert expect <= got
    assert {d for d, _ in got} <= {d for d, _ in docs if d % 3 == 0}
    planted = sum(d % 3 == 0 for d, _ in docs)
    assert len(got) > 0.9 * planted
    assert got == {(r.doc_id, r.item_id) for r in dc.find_leaks(frame, bench, block_items=7).collect()}
    assert {r.doc_id for r in dc.drop_leaks(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_recall_by_kind_of_edit(spark):
    """Whole and half copies, verbatim and edited, of items among random text: nine in ten or more of each kind."""
    rng = random.Random(11)
    word = lambda: f"v{int(rng.random() ** 3 * 4000)}"
    kinds = {
        "whole": lambda w: w,
        "every sixth word replaced": lambda w: [x if k % 6 else "new" + x for k, x in enumerate(w)],
        "every eighth word dropped": lambda w: [x for k, x in enumerate(w) if k % 8],
        "a word added after every eighth": lambda w: [y for k, x in enumerate(w) for y in ([x] if k % 8 else [x, "more"])],
        "first seventy per cent": lambda w: w[: len(w) * 7 // 10],
        "first half and a little": lambda w: w[: len(w) * 55 // 100],
        "last half, every tenth word replaced": lambda w: [x if k % 10 else "new" + x for k, x in enumerate(w[len(w) * 4 // 10 :])],
        "swapped neighbours": lambda w: [w[k + 1] if k % 20 == 0 and k + 1 < len(w) else w[k - 1] if k % 20 == 1 else x for k, x in enumerate(w)],
    }
    items = [[word() for _ in range(rng.randrange(25, 80))] for _ in range(20)]
    docs, planted = [], {}
    for name, edit in kinds.items():
        for k, item in enumerate(items):
            docs.append((len(docs), " ".join([word() for _ in range(80)] + edit(item) + [word() for _ in range(80)])))
            planted[len(docs) - 1] = (name, k)
    clean = range(len(docs), len(docs) + 200)
    docs += [(d, " ".join([word() for _ in range(160)] + items[d % 20][: len(items[d % 20]) // 4])) for d in clean]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    for name in kinds:
        caught = [(d, k) in got for d, (n, k) in planted.items() if n == name]
        assert sum(caught) >= 0.9 * len(caught), name
    assert not any(d in clean for d, _ in got)


def test_short_items(spark):
    items = ["one two three four five", "red green blue", "a b c d", "alpha beta gamma delta epsilon zeta"]
    texts = [
        "x one two OTHER four five y", "x red green blue y", "a b and c d", "alpha beta gamma NO epsilon zeta", "red green", "red x green blue y",
        "one three five", "a b c", "beta gamma delta zeta",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got >= {(0, 0), (1, 1), (2, 2), (3, 3)} and {d for d, _ in got} <= {0, 1, 2, 3}


def test_common_phrases_open_little(monkeypatch):
    """Items and texts full of the same stock phrases: few pairs are aligned, none of the copies is lost."""
    rng = random.Random(5)
    stock = ["one of the most", "in the end of", "as well as the", "it is one of the", "at the same time"]
    word = lambda: f"w{rng.randrange(20000)}"

    def text(n):
        out = []
        while len(out) < n:
            out += rng.choice(stock).split() if rng.random() < 0.02 else [word()]
        return out

    benchmark = [text(rng.randrange(20, 60)) for _ in range(2000)]
    items = dc.Items([(k, " ".join(w)) for k, w in enumerate(benchmark)])
    texts = [" ".join(text(200) + (benchmark[d] if d % 4 == 0 else [])) for d in range(200)]
    column = pa.array(texts)
    counts = next(iter(dc._count(items)(iter([pa.record_batch([column], names=["text"])]))))
    frequency = np.zeros(len(items.seeds), np.int64)
    frequency[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    items.close(frequency)
    aligned = []
    whole = dc.copied
    monkeypatch.setattr(dc, "copied", lambda a, b: aligned.append(1) or whole(a, b))
    found = {(r, k) for r, k, _ in dc._leaks(items, column)}
    assert {(d, d) for d in range(0, 200, 4)} <= found
    assert len(aligned) < 8 * len(found)


def test_very_long_item_and_text():
    """An item of 12,000 words against a text of 15,000: memory in proportion to the text, not to their product."""
    rng = np.random.default_rng(3)
    item = rng.integers(1, 5000, 12000)
    text = np.concatenate([np.zeros(1500, np.int64), item, np.zeros(1500, np.int64)])
    text[2000:12000:9] = 0
    tracemalloc.start()
    found = dc.copied(item, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and found[0] > 0.85 and peak < 20e6


def test_leak_in_most_documents(spark):
    rng = random.Random(9)
    item = [f"k{k}" for k in range(30)]
    docs = [(d, " ".join([f"a{rng.randrange(500)}" for _ in range(50)] + (item if d % 2 else []))) for d in range(200)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "the the the the"), (3, None), (4, "one two"), (None, "")], "item_id long, text string")
    got = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, 1) for d in range(1, 200, 2)}
    assert all(r.similarity == 1 and r.end_word - r.start_word == 30 for r in got)


def test_documents_against_whole_alignment(small, spark, data):
    """Every pair is aligned without seeds; verbatim copies and near ones are found, nothing else is."""
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    items = dc.Items([(r.item_id, r.text) for r in bench.collect()])
    expect = set()
    for r in small.select("doc_id", "text").collect():
        numbers = items.numbers([r.text])[0]
        for k, ws in enumerate(items.words):
            if len(ws) >= dc.SEED and 5 * np.isin(numbers, ws).sum() >= 4 * dc.least_span(len(ws)):
                if dc.copied(ws, numbers):
                    expect.add((r.doc_id, items.ids[k]))
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(small, bench).collect()}
    assert got == expect and got


def test_odd_rows(odd, none, spark, data):
    bench = spark.read.parquet(f"{data}/benchmark.parquet").withColumnRenamed("item_id", "item_id")
    assert dc.find_leaks(odd, bench).collect() == []
    assert dc.find_leaks(none, bench).collect() == []
    assert dc.find_leaks(odd, bench.limit(0)).collect() == []
    kept = dc.drop_leaks(odd, bench)
    assert kept.schema == odd.schema and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    # rows that share a doc_id, or have none, are judged each by its own text
    bench = spark.createDataFrame([(1, "negative id one"), (None, "another text of one doc_id one")], "item_id long, text string")
    for block in (1, 9):
        left = dc.drop_leaks(odd, bench, block)
        assert left.count() == odd.count() - 2 and left.where("doc_id = 8").count() == 2
    bench = spark.createDataFrame([(1, "a row without id one common line here two common line here")], "item_id long, text string")
    left = dc.drop_leaks(odd, bench)
    assert left.where("doc_id is null").count() == 1 and left.count() < odd.count()


def test_rows_stay_out_of_python(spark, odd):
    """A pass sends texts to Python and gets flags back; the rows with their other columns stay in the executor's heap."""
    bench = spark.createDataFrame([(1, "one common line here and some words more")], "item_id long, text string")
    plan = dc.drop_leaks(odd, bench)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
