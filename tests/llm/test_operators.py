"""The training-data operators against brute force, with the cases their docstrings define."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridweave.llm import bpe, chunks, decontam, langid, ring, secrets, simhash, sketch, toxicity, warc
from gridweave.llm.queries import tokenizer

from .conftest import LONG, ROWS

BLANKS = "\x20\x09-\x0d"


# -- 1: WARC


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 200
    rows = [(1, "http://www.a.org/x?b=1#f", big), (2, "http://b.a.org/", big), (3, None, None), (4, "http://a.org/x", "short\r\n\r\nWARC/1.1\r\n"), (5, "http://a.org/x", "short\r\n\r\nWARC/1.1\r\n"), (6, "ftp://Ü.example:80/p", big), (6, "ftp://Ü.example:80/p", big)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    warc.write_archives(pages, str(tmp_path / "w"), records_a_file=2)
    got = warc.merge_index(warc.read_archives(spark, str(tmp_path / "w")), rows=2).orderBy("part", "place").collect()
    sizes = {r[0]: len((r[2] or "").encode()) for r in rows}
    digest = {r[0]: hashlib.sha256((r[2] or "").encode()).hexdigest() for r in rows}
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        revisit = r.page_id in (2, 6)
        assert (r.payload_bytes, r.payload_digest) == (sizes[r.page_id], digest[r.page_id])
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys)


def test_warc_odd_rows(spark, tmp_path):
    """A null id, a very long payload, and repeated rows of the smallest id."""
    long = "x" * 3_000_000
    rows = [(None, "http://b.org/", "null id " * 20), (1, "http://a.org/", long), (2, "http://a.org/", long), (1, "http://a.org/", long), (None, "http://b.org/", None)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), archive_bytes=1 << 20)
    got = warc.merge_index(warc.read_archives(spark, str(tmp_path / "w"))).orderBy("part", "place").collect()
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got] == [(1, 3_000_000, "response", None), (1, 3_000_000, "response", None), (2, 3_000_000, "revisit", 1), *[(None, n, "response", None) for n in (got[3].payload_bytes, got[4].payload_bytes)]]
    assert {r.payload_bytes for r in got[3:]} == {0, 160}


def test_merge_holds_one_range():
    """The memory of a merging task depends on a range, not on how many there are."""
    import tracemalloc

    import pyarrow as pa

    def batches(ranges):
        for part in range(ranges):
            rows = [[{"page_id": i, "url": "u", "url_key": f"k{i:05d}", "captured": "", "record_type": "response", "refers_to": None, "payload_bytes": 1, "payload_digest": "d"} for i in range(run, 200, 4)] for run in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * 4, pa.int32()), pa.array(rows, pa.list_(warc._PLACE))], ["part", "rows"])

    peaks = []
    for ranges in (20, 400):
        tracemalloc.start()
        before = pa.total_allocated_bytes()
        n = most = 0
        for out in warc._merge(batches(ranges)):
            n += out.num_rows
            most = max(most, pa.total_allocated_bytes() - before)
            assert out.column("page_id").to_pylist() == list(range(200))
        peaks.append(tracemalloc.get_traced_memory()[1] + most)
        tracemalloc.stop()
        assert n == 200 * ranges
    assert peaks[1] < 1.5 * peaks[0]


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.merge_index(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted(rng.integers(0, 20, rng.integers(0, 9)).tolist()) for _ in range(k)]
    assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(sum(runs, []))


# -- 2: SimHash


def _simhash(text):
    words = re.findall(rb"[^" + BLANKS.encode() + rb"]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints):
    root = {p: p for p in set(prints)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in root}


def test_simhash_groups(spark, docs):
    got = simhash.groups(docs).collect()
    prints = [_simhash(t) for _, t in ROWS]
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((i, p) for (i, _), p in zip(ROWS, prints, strict=True))
    root = _groups(prints)
    least = {}
    for (i, _), p in zip(ROWS, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert {(r.doc_id, r.component_id) for r in got} == {(i, least[root[p]]) for (i, _), p in zip(ROWS, prints, strict=True)}
    assert simhash.groups(docs.where("false")).count() == 0


def test_simhash_links_are_complete(spark):
    """Random fingerprints with planted chains, small blocks so that band values are cut."""
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for i in range(150):
        p = prints[rng.integers(0, len(prints))]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            p ^= 1 << int(b)
        prints.append(p)
    prints += [(7 << 48) | int(x) for x in rng.integers(0, 1 << 16, 200)]  # one crowded band value
    signed = np.unique(np.array(prints, np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    parts = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.links(df, block=16)).collect()}
    want = _groups(prints)
    size = Counter(want.values())
    assert {p for p in want if size[want[p]] > 1} == set(parts)
    by_root = defaultdict(set)
    for p, r in parts.items():
        by_root[r].add(want[p])
    assert all(len(x) == 1 for x in by_root.values()) and len(by_root) == sum(n > 1 for n in size.values())


def test_simhash_deduplicate(docs):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 6, 7, 8, 9, None], key=str)


# -- 3: ring


@pytest.mark.parametrize(("n", "shards", "slack"), [(0, 5, 0), (3, 5, 0), (1003, 7, 0), (1003, 7, 0.1)])
def test_ring_bounds(spark, n, shards, slack):
    rows = spark.range(n).select((F.col("id") % 700).alias("k"), F.lit(1).alias("shard_"))
    got = ring.assign(rows, "k", shards, nodes=8, slack=slack).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == n and all(0 <= s < shards for s in counts)
    assert all(counts[s] <= b for s, b in enumerate(ring.bounds(n, shards, slack)))
    if not slack and n:
        assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_ring_moves_clockwise():
    """Without a binding limit a cell's rows go to the next virtual node; with one the rest goes further."""
    taken = ring.ring(4, 4, 64)
    places = sorted(taken)
    cell = places[2]
    assert ring.routes({cell: 5}, 4, 4, 64, slack=9.0) == [{"cell": cell, "first": 0, "last": 5, "shard": taken[cell], "slot": 0}]
    out = ring.routes({cell: 8}, 4, 4, 64)
    order = list(dict.fromkeys(taken[places[(2 + i) % 16]] for i in range(16)))
    assert [r["shard"] for r in out] == order and [r["first"] for r in out] == [0, 2, 4, 6]


def test_ring_growth_moves_little(spark):
    """With slack, one more shard moves about a shard's worth of rows."""
    rows = spark.range(4000).withColumnRenamed("id", "k")
    a = {r.k: r.shard for r in ring.assign(rows, "k", 10, slack=0.5).collect()}
    b = {r.k: r.shard for r in ring.assign(rows, "k", 11, slack=0.5).collect()}
    assert sum(a[k] != b[k] for k in a) < 4000 * 3 / 11


def _walk(keys, shards, cells):
    """The ring by definition: every row asks one virtual node a round, clockwise, cell by cell."""
    taken = ring.ring(shards)
    places = sorted(taken)
    room = ring.bounds(len(keys), shards)
    full = [0] * shards
    by_cell = Counter(cells)
    at = {c: next((i for i, p in enumerate(places) if p >= c), 0) for c in by_cell}
    waiting = [[c, at[c], n] for c, n in sorted(by_cell.items())]
    taken_by = defaultdict(Counter)
    while waiting:
        for w in waiting:
            shard = taken[places[w[1] % len(places)]]
            take = min(w[2], room[shard] - full[shard])
            taken_by[w[0]][shard] += take
            full[shard] += take
            w[2] -= take
            w[1] += 1
            while w[2] and full[taken[places[w[1] % len(places)]]] >= room[taken[places[w[1] % len(places)]]]:
                w[1] += 1
        waiting = [w for w in waiting if w[2]]
    return {c: +n for c, n in taken_by.items()}


def test_ring_is_determined_by_its_rows(spark):
    """However the rows are partitioned: a third has one key, a sixth is one row, and a tenth has no key."""
    n = 3000
    i = F.col("id")
    rows = spark.range(n).select(F.when(i % 3 == 0, 7).when(i % 10 == 1, None).otherwise(i).alias("k"), F.when(i % 6 == 0, 1).otherwise(i).alias("v"))
    a = [tuple(r) for r in ring.assign(rows.repartition(3, "v"), "k", 40, groups=64).collect()]
    b = [tuple(r) for r in ring.assign(rows.orderBy(F.desc("v")).repartition(7), "k", 40, groups=64).collect()]
    assert Counter(a) == Counter(b) and len(a) == n
    cells = {r.k: r.c for r in rows.select("k", ring.cell_of(F.col("k")).alias("c")).distinct().collect()}
    got = defaultdict(Counter)
    for k, _, shard, _ in a:
        got[cells[k]][shard] += 1
    assert got == _walk([x[0] for x in a], 40, [cells[x[0]] for x in a])


def test_ring_movement_without_slack(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    a = {r.k: r.shard for r in ring.assign(rows, "k", 40).collect()}
    b = {r.k: r.shard for r in ring.assign(rows, "k", 41).collect()}
    moved = sum(a[k] != b[k] for k in a)
    assert 20_000 // 41 <= moved < 0.09 * 20_000


def test_shard_documents(docs):
    got = ring.shard_documents(docs, 3).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)


# -- 4: language


def test_langid(spark, docs, no_docs):
    rows = [(i, f"the house and the garden {w} are nice and the dog is there", "en") for i, w in enumerate("abcdefghij")]
    rows += [(100 + i, f"das haus und der garten {w} sind schön und der hund ist dort", "de") for i, w in enumerate("abcdefghij")] + [(200, None, "fr"), (201, "xyz", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r.p for r in docs.select("doc_id", langid.predict(model, "text", spark).alias("p")).collect()}
    assert got[1].lang == "en" and got[8].lang == "de" and all(0 <= p.score <= 1 for p in got.values())
    assert all(got[i].lang == "und" and got[i].score == 0 for i in (3, 4, 5, 6))
    nothing = langid.train(no_docs)
    assert nothing.predict("some text") == ("und", 0.0)
    assert no_docs.select(langid.predict(model, "text", spark)).count() == 0


def test_langid_filter_has_all_grams():
    rng = np.random.default_rng(1)
    own = {f"l{i:02d}": rng.integers(0, 1 << 62, 500).astype(np.uint64) for i in range(70)}  # more than one word of bits
    model = langid.Filter(own)
    for i, name in enumerate(model.languages):
        assert ((model.masks(own[name])[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = model.masks(rng.integers(0, 1 << 62, 20_000).astype(np.uint64))
    rate = ((other[0] >> np.uint64(3)) & np.uint64(1)).mean()
    assert abs(rate - model.false_positive[3]) < 0.01


def test_langid_pieces():
    text = "Ärger, " * 200_000
    whole = np.concatenate(list(langid.grams(text)))
    assert len(whole) == 5 * 200_000 and len(np.unique(whole)) == 5


# -- 5: chunks


def test_chunks_resist_shifts():
    text = np.random.default_rng(0).bytes(20_000).hex().encode()
    a, b = set(chunks.chunks(text)[0]), set(chunks.chunks(b"inserted " + text)[0])
    assert len(a & b) > 0.95 * len(a)
    ends = chunks.borders(b"x" * 5000)
    assert ends[-1] == 5000 and (np.diff(ends) <= chunks.MAX_BYTES).all()


def test_repeated_passages(spark, docs):
    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(4000)]
    shared = " ".join(words[:60])
    rows = [(1, "ä " + " ".join(words[100:200]) + " " + shared + " " + " ".join(words[200:300])), (2, " ".join(words[300:333]) + " " + shared), (3, " ".join(words[400:700])), (4, None), (5, shared + " " + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunks.repeated_passages(df).collect()
    text = dict(rows)
    assert {r.doc_id for r in got} == {1, 2, 5}
    for r in got:
        assert text[r.doc_id][r.start : r.end] == shared and r.n_words == 60 and r.first_doc == (5 if r.doc_id == 1 else 1)
    left = {r.doc_id: r.text for r in chunks.remove_repeats(df).collect()}
    assert left[1] == text[1] and left[3] == text[3] and left[4] is None
    assert left[2] == text[2].removesuffix(shared) and left[5] == " "
    # The long text is one line over and over, and no other document has it.
    found = chunks.repeated_passages(docs)
    assert found.count() == 0 and chunks.remove_repeats(docs).columns == docs.columns
    assert sorted(map(str, chunks.remove_repeats(docs).collect())) == sorted(map(str, docs.collect()))
    assert chunks.repeated_passages(docs.where("false")).count() == 0


def test_passages_are_of_one_document(spark):
    """Sentences side by side that are in other documents one by one, or two by two, make no passage."""
    rng = np.random.default_rng(12)
    sentences = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(14)) for _ in range(12)]
    rows = [(0, " ".join(sentences)), *((i + 1, f"own{i} {sentences[i]} {sentences[i + 1]} end{i}") for i in range(11))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert chunks.repeated_passages(df).count() == 0
    assert {r.doc_id: r.text for r in chunks.remove_repeats(df).collect()} == dict(rows)
    short = chunks.repeated_passages(df, min_words=25).where("doc_id = 0").collect()
    assert short and max(r.n_words for r in short) == 28


def test_passages_of_repeated_rows(spark):
    rng = np.random.default_rng(13)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "some text"), (3, "other text")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.end, r.n_words, r.first_doc) for r in chunks.repeated_passages(df).collect()) == [(1, 0, len(text), 80, 2), (2, 0, len(text), 80, 1)]
    assert sorted((r.doc_id, r.text) for r in chunks.remove_repeats(df).where("doc_id is not null").collect()) == [(1, text), (1, text), (2, ""), (3, "other text"), (3, "some text")]


def test_passages_equal_brute_force(spark):
    """Every document that has 51 words or more of another one is found, and nothing that no other document has."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}

    def sharing(size):
        seen = defaultdict(set)
        for i, t in text.items():
            w = t.split()
            for k in range(len(w) - size + 1):
                seen[" ".join(w[k : k + size])].add(i)
        return {i for ids in seen.values() if len(ids) > 1 for i in ids}

    got = chunks.repeated_passages(docs).collect()
    found = {r.doc_id for r in got}
    must = sharing(51)
    assert len(must - found) <= 0.02 * len(must) and found <= sharing(chunks.MIN_WORDS)
    for r in got:
        passage = text[r.doc_id][r.start : r.end]
        assert len(passage.split()) == r.n_words >= chunks.MIN_WORDS and passage in text[r.first_doc] and r.first_doc != r.doc_id


# -- 6: sketches


def _shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_sketches_are_exact_when_small(spark, docs):
    k = 32
    got = sketch.sketches(docs, k=k).collect()
    for r in got:
        assert list(r.sketch) == sorted(set(r.sketch)) and len(r.sketch) <= k
    by = {r.doc_id: r for r in got}
    assert by[1].sketch == by[2].sketch and by[3].sketch == by[4].sketch == by[5].sketch == []
    assert by[1].n_distinct == len(_shingles(ROWS[0][1])) == 16


def test_sketch_merge_and_estimates(spark):
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    whole = F.slice(F.sort_array(F.array_union(sketch.shingle_hashes(F.col("a")), sketch.shingle_hashes(F.col("b")))), 1, sketch.K)
    df = spark.createDataFrame([(a, b)], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"), whole.alias("ab"))
    r = df.select(sketch.resemblance(F.col("a"), F.col("b")).alias("j"), sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.distinct_count(F.col("a")).alias("n"), (sketch.merged(F.col("a"), F.col("b")) == F.col("ab")).alias("m")).first()
    assert abs(r.j - 1 / 3) < 0.15 and abs(r.c - 0.5) < 0.2 and abs(r.n - 1996) < 600
    assert r.m


def test_neighbours(spark, docs):
    got = {r.doc_id: r for r in sketch.neighbours(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), rows=2).collect()}
    text = {i: t or "" for i, t in ROWS if i is not None}
    ids = sorted(text)
    for n, i in enumerate(ids):
        own, following = text[i], text[ids[(n + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert got[i].n_chars == len(own)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].next_sketch == got[ids[(n + 1) % len(ids)]].sketch
    assert sketch.neighbours(docs.where("false")).count() == 0
    assert sketch.neighbours(docs, rows=1).count() == len(ROWS)


def test_ranges_cover_clustered_ids(spark):
    ids = spark.createDataFrame([(x,) for x in [0, 1, 2, 3, 10**15, 10**15 + 1, *range(5000, 5500)]], "key long")
    edges, pieces = sketch._edges(ids, 3)
    got = ids.select("key", sketch._range_of(F.col("key"), edges, pieces).alias("r")).orderBy("key").collect()
    parts = [r.r for r in got]
    assert parts == sorted(parts) and max(Counter(parts).values()) <= 20


# -- 7: decontamination


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_contamination(spark, docs):
    items = [(1, "QUICK brown-fox jumps over; the lazy dog and runs away from the"), (2, "lorem ipsum"), (3, None), (4, "!!"), (5, "über den"), (5, "über den"), (6, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 3):
        got = decontam.contamination(docs, bench, set_windows=size).collect()
        assert len(got) == len(ROWS)
        for r in got:
            text = next(t for i, t in ROWS if i == r.doc_id)
            w = _words(text)
            hit, names = set(), set()
            for i, t in items:
                iw = _words(t)
                n = min(10, len(iw))
                windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
                for k in range(len(w) - n + 1 if n else 0):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        names.add(str(i))
            assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (len(w), len(hit), len(names), sorted(names), bool(hit))
    assert decontam.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {3, 4, 5, 6, None, 9}
    assert decontam.decontaminate(docs, bench, set_windows=3).count() == 6
    spans = decontam.decontaminate(docs, bench, remove="spans")
    assert spans.columns == docs.columns
    by = {r.doc_id: r.text for r in spans.collect()}
    assert by[8] == "Der schnelle braune Fuchs springt  faulen Hund" and by[3] is None and by[6] == ROWS[6][1]


# -- 8: toxicity


def test_toxicity_learns(spark, no_docs):
    rng = np.random.default_rng(4)
    vocabulary = [f"word{x}" for x in range(300)]

    def text(bad):
        w = [vocabulary[i] for i in rng.integers(0, 300, 30)]
        return " ".join(w + ["stinker"] * bad)

    rows = [(i, text(i % 5 == 0)) for i in range(1000)] + [(1000, None), (1001, "")]
    labels = [(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(model, "text", spark).alias("s")).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(300, 1000)) and 0 <= got[1000] <= 1 and got[1000] == got[1001]
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.score("stinker") == empty.score(None)
    assert toxicity.train(no_docs, spark.createDataFrame(labels, "doc_id long, toxic int")).score("x") <= 1


def test_risk_stays_non_negative():
    """Every unlabelled row has the feature as often as the positives: nothing to learn, no blow-up."""
    rows = [np.array([0])] * 40
    w, b = toxicity.fit(rows, np.array([True] * 20 + [False] * 20), 1, 0.3)
    assert np.isfinite(w).all() and abs(1 / (1 + np.exp(-(b + w[0]))) - 0.3) < 0.1


# -- 9: BPE


def test_bpe_merges_exactly():
    rng = np.random.default_rng(6)
    ranks = {bytes([i]): i for i in range(256)}
    corpus = "".join(rng.choice(list("abcde "), 4000, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1])).encode()
    parts = [corpus[i : i + 1] for i in range(len(corpus))]
    while len(ranks) < 330:  # a small vocabulary, made by the definition of merging
        best = Counter(zip(parts, parts[1:], strict=False)).most_common(1)[0][0]
        ranks[best[0] + best[1]] = len(ranks)
        out, i = [], 0
        while i < len(parts):
            pair = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
            out.append(parts[i] + parts[i + 1] if pair else parts[i])
            i += 2 if pair else 1
        parts = out
    codec = bpe.Codec(bpe.Tables(ranks, r"[\s\S]+"))
    for _ in range(400):
        piece = "".join(rng.choice(list("abcde é"), rng.integers(0, 40))).encode()
        assert [codec.tokens[i] for i in codec.piece(piece)] == bpe.merge(piece, ranks)


def test_bpe_equals_library(spark, docs):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.token_digests(docs, tokenizer(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for i, t in ROWS if i == r.doc_id) or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    own = tokenizer(spark)
    back = bpe.tokenize(docs, own).select("text", own.decode("token_ids").alias("b")).collect()
    assert all(bytes(r.b) == (r.text or "").encode() for r in back)


# -- 10: secrets


def test_secrets_lexing():
    text = 'host = "localhost"\nk = "Zx9Qw7Lp2Vt4"\nalias = k\nclient_secret: str = alias\nconst apiKey = "abCD1234" + "efGH5678"\npassword = "changeme"\nThe token: was lost\n'
    found = [text[s.first : s.last] for s in secrets.secrets_in(text) if s.kind == "literal"]
    assert found == ["Zx9Qw7Lp2Vt4", "abCD1234", "efGH5678"]
    assert "Zx9" not in secrets.redact(text, secrets.secrets_in(text))
    assert secrets.secrets_in("a = b\nb = a\nsecret_key = a\n") == []


def test_base_spans():
    text = 'é PASSWORD="abcdef" token:abc AKIA' + "A" * 16 + " " + "0f" * 12 + " api-key api_key = x.y/z+1="
    got = [(s.kind, text[s.start : s.end]) for s in secrets.base_spans(text)]
    assert got == [("assign", 'PASSWORD="abcdef'), ("access", "AKIA" + "A" * 16), ("hex", "0f" * 12), ("assign", "api_key = x.y/z+1=")]


def test_secret_digests(spark, docs, no_docs):
    got = secrets.secret_digests(docs).collect()
    assert len(got) == len(ROWS) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.secret_digests(no_docs).count() == 0
    df = spark.createDataFrame([("x password=hunter22 y",), (None,)], "text string")
    assert [r[0] for r in df.select(secrets.redacted("text")).collect()] == ["x password=[SECRET] y", None]
    assert [len(r[0]) for r in df.select(secrets.find_secrets("text")).collect()] == [2, 0]


def test_long_line_is_linear():
    import time

    began = time.perf_counter()
    secrets.secrets_in("password " + "a" * 300_000 + " = " + "b" * 300_000)
    secrets.secrets_in("token " + "a.b:" * 50_000)
    assert time.perf_counter() - began < 20


def test_long_text_is_whole():
    assert len(LONG) > 1_000_000
