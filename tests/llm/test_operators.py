"""Each operator against a brute-force version, a round trip or held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import decontaminate, jaccard, lines, packing, pfor, pitman_yor, quality, substring, suffixes, token_files, toxicity
from tidewatch.llm.encode import Encoder, vocabulary_path
from tidewatch.llm.queries import ORACLES, QUERIES
from tidewatch.llm.words import flat

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (x[sorted(x.columns)].sort_values([c for c in ("doc_id", "conv_id", "lang", "rank") if c in x.columns]).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        assert (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, rows, n, percent):
    got = {r[0]: (r[2], r[3]) for r in jaccard.similarity_classes(docs, n, percent).collect()}
    assert got == brute.components(rows, n, percent)


def test_jaccard_large_groups(spark, monkeypatch):
    """Blocks above one tree node, and groups dealt to several parts, lose no link."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(3)]
    made = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        made.append((i, " ".join(w[:rng.choice([120, 118, 110])])))
    got = {r[0]: (r[2], r[3]) for r in jaccard.similarity_classes(table(spark, made), 3, 90).collect()}
    assert got == brute.components(made, 3, 90)


def test_one_of_each_stays(spark, docs, rows):
    want = {c for _, c in brute.components(rows, 5, 80).values()}
    kept = jaccard.keep_one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == want


def test_suffixes(spark, docs, rows):
    got = {r[0]: tuple(r[1:]) for r in suffixes.op2_suffix_dedup(spark, SF).collect()}
    assert got == brute.repeated_bytes(rows)


@pytest.mark.parametrize("pairwise", [1, 8])
def test_suffixes_overlapping(spark, monkeypatch, pairwise):
    monkeypatch.setattr(suffixes, "PAIRWISE", pairwise)
    rng = random.Random(2)
    base = ["".join(rng.choice("abcd ") for _ in range(400)) for _ in range(6)]
    made = []
    for i in range(120):
        x = "".join(rng.choice(base)[(a := rng.randrange(250)):a + rng.randrange(60, 200)] for _ in range(rng.randrange(5)))
        made.append((i, (x + "ab" * 300) if i % 17 == 0 else (x + "é" * 130) if i % 23 == 0 else x))
    got = {r[0]: (r[1], r[2], r[3], r[4]) for r in suffixes.remove_repeated_bytes(table(spark, made)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute.repeated_bytes(made)


@pytest.mark.parametrize("most", [suffixes.MOST_CELLS, 2])
def test_suffixes_of_a_passage_in_very_many_texts(spark, monkeypatch, most):
    """Its edges, with other text around them in each document, make no group of all documents."""
    monkeypatch.setattr(suffixes, "HOT", 100)
    monkeypatch.setattr(suffixes, "MOST_CELLS", most)
    rng = random.Random(3)
    other = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = other(400)
    made = table(spark, [(i, other(90) + passage + other(90)) for i in range(600)] + [(7, None), (600, passage * 2)])
    runs = suffixes.suffix_runs(suffixes.keyed(made)).groupBy("part").agg(F.sum(F.length("length")).alias("n")).agg(F.max("n")).first()[0]
    assert runs < 300
    got = {r[0]: (r[1], r[2], r[3], r[4]) for r in suffixes.remove_repeated_bytes(made.where("text is not null")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute.repeated_bytes([(r.doc_id, r.text) for r in made.where("text is not null").collect()])


def test_loser_tree_keeps_common_prefixes():
    rng = random.Random(1)
    runs, every = [], []
    for _ in range(7):
        x = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(40)))
        every += x
        runs.append(suffixes.Run(*(y if isinstance(y, bytes) else y.tobytes() for y in suffixes.front_code(x))) if x else suffixes.Run(b"", b"", b""))
    got = list(suffixes.merged(runs))
    keys = [g[3] for g in got]
    assert keys == sorted(every)
    assert all(g[2] == suffixes.beyond(a, b, 0) for g, a, b in zip(got[1:], keys, keys[1:], strict=False))


def test_decontamination(spark, docs, rows):
    items = [(r.item_id, r.text.encode().lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.op3_decontamination(spark, SF).collect()}
    rng = random.Random(1)
    some = rng.sample([r for r in rows if len(r[1]) < 3000], 25) + [r for r in rows if r[0] in {d for d, _ in got} and len(r[1]) < 6000][:10]
    for i, t in some:
        w = t.encode().lower().split()
        for k, item in items:
            d = brute.infix_distance(item, w)
            assert ((i, k) in got) == (d <= len(item) // 5) and got.get((i, k), d) == d


def test_decontamination_recall(spark):
    """Items with as many edits as allowed, put into texts: at least 0.95 are found."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in bench.collect()]
    rng = random.Random(3)
    made, want = [], set()
    for i in range(400):
        k, w = rng.choice(items)
        w = list(w)
        for _ in range(len(w) // 5):
            p = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[p:p + (kind < 2)] = [f"zz{rng.randrange(999)}"] if kind != 1 else []
        made.append((i, " ".join([f"a{rng.randrange(99)}" for _ in range(30)] + w + [f"b{rng.randrange(99)}" for _ in range(30)])))
        want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(table(spark, made), bench).collect()}
    assert len(want & got) >= 0.95 * len(want)


def test_pitman_yor(spark, rows):
    got = pitman_yor.op4_pitman_yor(spark, SF).toPandas().set_index("doc_id")
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(count[x] > 0 for x in w), n, held[i])
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    test, train = got[got.held_out], got[~got.held_out]
    assert test.score.sum() > test.base_score.sum()
    assert train.score.sum() / train.n_tokens.sum() > test.score.sum() / test.n_tokens.sum()


def test_pitman_yor_puts_nonsense_last(spark, docs):
    """Held-out texts of random letters score below every real text; trained ones below the real texts on the whole."""
    rng = random.Random(0)
    said = [(10**6 + k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(200))) for k in range(20)]
    got = pitman_yor.score(docs.select("doc_id", "text").unionByName(table(spark, said))).toPandas()
    each = got.score / got.n_tokens
    false = got.doc_id >= 10**6
    long = ~false & (got.n_tokens > 20)
    assert (false & got.held_out).any() and each[false & got.held_out].max() < each[long].min()
    assert np.corrcoef((got.n_known / got.n_tokens)[got.held_out], each[got.held_out])[0, 1] > 0.5


@pytest.mark.parametrize("c,weight,discount", [(6, 0.8, 0.5), (12, 3.0, 0.3), (2, 0.1, 0.9)])
def test_pitman_yor_seating_follows_the_posterior(c, weight, discount):
    """Sweeps over many equal dishes give table counts in proportion to weight ** t * S[c, t], summed up by hand."""
    seatings = {(1,): 1.0}   # sizes of tables -> product of chances, customer by customer
    for _ in range(c - 1):
        after = Counter()
        for sizes, p in seatings.items():
            after[(*sizes, 1)] += p * weight
            for k, x in enumerate(sizes):
                after[(*sizes[:k], x + 1, *sizes[k + 1:])] += p * (x - discount)
        seatings = {tuple(sorted(k)): 0.0 for k in after} | {}
        for k, p in after.items():
            seatings[tuple(sorted(k))] += p
    want = np.zeros(c + 1)
    for sizes, p in seatings.items():
        want[len(sizes)] += p
    rng = np.random.default_rng(5)
    n = 20_000
    t = np.ones(n, np.int64)
    for _ in range(40):
        t = pitman_yor.gibbs(rng, np.full(n, c), t, np.full(n, weight), discount, pitman_yor.stirling(discount))
    got = np.bincount(t, minlength=c + 1) / n
    assert np.abs(got - want / want.sum()).max() < 0.015


def test_pitman_yor_is_a_distribution():
    """Probabilities of all words and the unknown one add up to 1 for each context, with totals of the same seating."""
    rng = np.random.default_rng(0)
    value, at, context, n, _ = pitman_yor.pair_table(rng.zipf(1.5, 5000).astype(np.uint64) % np.uint64(300), rng.integers(0, 3, 5000).astype(np.uint16))
    context = context * 200  # restaurants of two classes
    customers = np.bincount(context, n, pitman_yor.CONTEXTS)
    base = {"n": customers, "N": 5000, "V": len(value), "known": 1 / (len(value) + 1), "discount": 0.5, "class_discount": 0.4, "root_discount": 0.5}
    above = [customers.reshape(pitman_yor.PARENTS, -1).sum(axis=1) / k for k in (2, 4)]
    seats = pitman_yor.Bucket(at, context, n, len(value), pitman_yor.learned(base, np.concatenate([customers / 2, *above, [1250, 300]])), 1)
    seats.sweep()
    assert (seats.tables >= 1).all() and (seats.tables <= n).all()
    seats.totals = t = pitman_yor.learned(base, seats.sums())
    sample = [(t, seats.tables, seats.root(t), seats.middle(t), n)]
    code = {(a, c): k for k, (a, c) in enumerate(zip(at.tolist(), context.tolist(), strict=True))}
    dishes = {c: k for k, c in enumerate(seats.dish_code.tolist())}
    for c in (0, 200, 400, 7, 300, 60000):  # the last three have no customers, and the last one's class has none either
        word = np.append(np.arange(len(value)), -1)
        pair = np.array([code.get((w, c), -1) for w in word.tolist()])
        dish = np.array([dishes.get(w * pitman_yor.PARENTS + c // pitman_yor.SLOTS, -1) if w >= 0 else -1 for w in word.tolist()])
        assert pitman_yor.probabilities(sample, word, dish, pair, np.full(len(word), c)).sum() == pytest.approx(1)


def test_toxicity_quotes_by_plain_search():
    """Hits between quotation marks as a search over the decoded surroundings of each finds them."""
    rng = random.Random(6)
    window = toxicity.WINDOW
    for _ in range(60):
        said = "".join(rng.choice(['"', "«", "»", "“", "”", "„", " ", " ", " ", "é", "ab", "x" * 5, " w w w w w w "]) for _ in range(rng.randrange(1, 120)))
        texts = flat(pa.array(["before \" text", said]))
        w = toxicity.words(texts)
        own = np.arange(w.bounds[1], w.bounds[2])
        if not len(own):
            continue
        raw, begin, want = texts.text(1), texts.offsets[1], []
        for x in own.tolist():
            low, high = max(w.bounds[1], x - window), min(w.bounds[2], x + window + 1)
            head = raw[w.start[low] - begin:w.start[x] - begin + 1].decode(errors="ignore")
            tail = raw[w.start[x] - begin:w.end[high - 1] - begin].decode(errors="ignore")
            odd = raw[:w.start[x] - begin + 1].decode(errors="ignore").count('"') % 2 == 1
            want.append(odd and ('"' in head or '"' in tail) or any(head.rfind(a) > head.rfind(b) and b in tail for a, b in ("«»", "“”", "„“")))
        assert toxicity.Scorer.quoted(texts, w, 1, own).tolist() == want


def test_block_files_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        for high in (1, 2, 50_000, 2**32 - 1):
            ids = rng.integers(0, high, n).astype(np.uint32)
            if n > 300:
                ids[:128], ids[5] = 7, high
            file = pfor.write(np.arange(3), np.array([n, 0, 0]), ids, 9)
            doc_ids, lengths, back, before = pfor.read(file)
            assert (back == ids).all() and before == 9 and lengths.tolist() == [n, 0, 0] and doc_ids.tolist() == [0, 1, 2]
            if n:
                k = (n - 1) // pfor.BLOCK
                assert (pfor.read_block(file, k) == ids[k * pfor.BLOCK:]).all()


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    got = {r[0]: tuple(r[1:]) for r in token_files.op5_token_files(spark, SF).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = token_files.shared_folder(spark, "test-tokens")
    part = token_files.write_token_files(docs, folder, n_parts=3)
    back = {r.doc_id: r.ids for r in token_files.read_token_files(spark, folder, part).collect()}
    assert all(back[i] == whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows[:40])


def test_encoder_on_odd_texts():
    import pyarrow as pa

    from tidewatch.llm.words import flat

    coder = Encoder(vocabulary_path())
    odd = ["It's a test. x'. y's, Ünï. <|endoftext|> foo <|StartOfText|> a b　c İİ. 12.5, 1. ... a.. É. 'll't\x1c z\x85q", "", None, " . , a",
           "straße größe. naïve, K. ﬁn ǅ ΑΣ.", "é ́x İ"]
    for some in (odd, [x for x in odd if x and "<|" not in x]):
        ids, first = coder.encode(flat(pa.array(some)))
        for k, x in enumerate(some):
            assert ids[first[k]:first[k + 1]].tolist() == coder.tokenizer.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_lines(spark, docs, rows, m):
    got = {r.doc_id: (r._n_lines, r._n_removed, r.text) for r in lines.remove_repeated_lines(docs, m).collect()}
    assert got == brute.lines(rows, m)


def test_ledger_policies_and_ablations(spark, docs):
    entries = quality.ledger(docs).cache()
    got = {(r.policy, r.version, r.rule): (r.n_failed, r.n_only) for r in quality.ablations(entries).collect()}
    failed = [r.failed for r in entries.select("failed").collect()]
    for p in quality.POLICIES:
        for k, rule in enumerate(quality.RULES):
            if rule.name in p.rules:
                assert got.get((p.name, p.version, rule.name), (0, 0)) == (
                    sum(f >> k & 1 for f in failed), sum(f & p.mask() == 1 << k for f in failed))
    entries.unpersist()


def test_toxicity(spark):
    got = toxicity.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    test = got.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    assert (test.predicted == test.toxic).mean() > 0.97
    assert test.score[test.toxic == 1].median() > 0.5 > test.score[test.toxic == 0].quantile(0.95)
    assert (test.predicted == (test.score >= 0.5)).all()


def test_automaton():
    lexicon = toxicity.Lexicon([("worthless", False, 3.0), ("lowei", True, 2.0), ("scum", False, 1.0)])
    words = {"worthless": (0, 0), "wortless": (1, 0), "worthlesss": (1, 0), "xworthless": (1, 0), "wurthless": (1, 0), "warthlas": (9, -1),
             "loweix": (0, 1), "lowei": (0, 1), "lwei": (9, -1), "scum": (0, 2), "scun": (9, -1), "": (9, -1)}
    assert {w: lexicon.match(w) for w in words} == words


def test_a_sketch_too_wide_for_a_task_sends_no_more_suffixes(spark, docs, rows, monkeypatch):
    sent = lambda: suffixes.suffix_runs(suffixes.keyed(docs)).agg(F.sum(F.length("length"))).first()[0]
    whole = sent()
    monkeypatch.setattr(suffixes, "MOST_CELLS", 2)
    assert sent() <= whole * 1.01
    got = {r[0]: tuple(r[1:]) for r in suffixes.op2_suffix_dedup(spark, SF).collect()}
    assert got == brute.repeated_bytes(rows)


def test_windows_of_texts_with_very_many_hits():
    scorer = toxicity.Scorer([("scum", False, 1.5)])
    for n in (10, 1999, 2000, 2500):
        texts = flat(pa.array(["scum " * 5 + "fine people " * 20 + "scum thing " * (n - 5)]))
        assert math.isclose(scorer.features(texts)[0, -1], math.log1p(1.5 * (9 if n > 13 else 5)))


def test_substring(spark, docs, rows):
    for n in (50, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeated_windows(docs, n).collect()}
        assert got == brute.substring(rows, n)


def test_substring_sketch_overestimates_and_keeps_its_load(spark, docs):
    """Every repeated minimizer comes back; few others do, whatever the number of places."""
    own = substring.keyed(docs)
    for n, copies in ((50, 1), (10, 1), (10, 3)):
        more = own
        for k in range(1, copies):
            more = more.unionByName(own.withColumns({"_id": F.col("_id") + 10**6 * k, "text": F.expr(f"translate(text, 'aeiou', '{'eiouaeiou'[k:k + 5]}')")}))
        table_ = more.select("_id", "_fp", "text").toArrow().combine_chunks()
        value, doc = substring.run_values(n)(flat(table_.column("text").chunk(0)))
        width = substring.sketch_width(len(value))
        back = {r._id: r.cells for r in substring.with_repeated_cells(more, substring.run_values(n), width).where("cells is not null").select("_id", "cells").collect()}
        times, found = Counter(value.tolist()), 0
        ids = table_.column("_id").to_pylist()
        cell = substring.cells(value, 0, width).tolist()
        for v, d, c in zip(value.tolist(), doc.tolist(), cell, strict=True):
            inside = c in back.get(ids[d], ())
            assert inside or times[v] == 1
            found += inside and times[v] == 1
        assert found <= 0.05 * len(value)


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    got = packing.op10_best_fit_packing(spark, SF).toPandas()
    for i, t in rows[:40]:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[:-1] == 2048).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a:a + 2048].tobytes()) for a in own.start]
    order = got.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id").length.cumsum() - order.length == order.offset).all()
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and len(fill) <= -(-got.length.sum() // 2048) + 2


def test_packing_over_several_groups(spark, docs):
    one = packing.pack_documents(docs).select("sequence_id").distinct().count()
    many = packing.pack_documents(docs, group=20).select("sequence_id").distinct().count()
    assert many <= one + 3


def test_packing_groups_stay_bounded(spark, monkeypatch):
    """Long pieces that leave every bin open don't end in one group."""
    rows = spark.range(400).selectExpr("id AS _id", "id AS _fp", "0 AS piece", "0L AS start", "1100 + id % 900 AS length", "id AS ids_crc32")
    monkeypatch.setattr(packing, "pieces", lambda *_: rows)
    got = packing.pack_documents(rows.selectExpr("_id AS doc_id", "'' AS text"), group=40).toPandas()
    assert len(got) == 400 == got.sequence_id.nunique()
    assert (got.sequence_id // (1 << 24)).value_counts().max() < 100


def test_local_search_only_improves():
    rng = np.random.default_rng(0)
    for length in (rng.integers(1, 2048, 3000), rng.integers(400, 1000, 2000), np.full(50, 1500), np.array([], np.int64)):
        first = packing.Bins(length, 2048)
        first.best_fit()
        before = sum(bool(x) for x in first.items)
        bins = packing.pack(length)
        assert (np.bincount(bins, length) <= 2048).all() and (bins.max() + 1 if len(bins) else 0) <= before


def test_local_search_ends_without_a_raising_step():
    length = np.random.default_rng(1).integers(400, 900, 6000)
    bins = packing.pack(length)
    room = 2048 - np.bincount(bins, length)
    taken = length + room[bins]
    for a in np.flatnonzero(room > packing.OPEN):
        own = length[bins == a]
        other = (bins != a) & (room[bins] > 0)
        sums = {*own.tolist(), *(int(own[i] + own[j]) for i in range(len(own)) for j in range(i))}
        assert not any((other & (s <= taken) & (taken < s + room[a]) & (length < s)).any() for s in sums)
        free = np.delete(room, a)
        assert not any(((s <= free) & (free < s + room[a])).any() for s in own)


def fewest_bins(lengths: list[int], capacity: int) -> int:
    """The fewest bins that hold all pieces, by trying every placing; equal rooms are tried once."""
    best = len(lengths)

    def place(k: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[k]}):
            at = rooms.index(room)
            place(k + 1, rooms[:at] + [room - lengths[k]] + rooms[at + 1:])
        place(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_packing_of_few_pieces_against_all_placings():
    """Up to ten pieces: never fewer bins than possible, never more than one above, and the fewest in nearly all cases."""
    rng = np.random.default_rng(3)
    fewest = 0
    for k in range(200):
        low, high = [(1, 2049), (300, 1100), (600, 800), (40, 1500)][k % 4]
        lengths = rng.integers(low, high, rng.integers(1, 11))
        bins = packing.pack(lengths)
        assert len(bins) == len(lengths) and np.bincount(bins, lengths).max() <= packing.CAPACITY
        used, least = len(set(bins.tolist())), fewest_bins(lengths.tolist(), packing.CAPACITY)
        assert least <= used <= least + 1
        fewest += used == least
    assert fewest >= 190
