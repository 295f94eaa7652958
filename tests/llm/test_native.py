"""Line deduplication, decontamination, components and the pipeline."""

import hashlib
import random
from collections import defaultdict

import corpus_pipeline
from quirefold.llm import components, decontaminate, lines, queries, quality, substring

from . import brute

SF = "/root/testdata/sf0.001"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey".split()


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 2000 + k) for k in range(50)] + [(3, 3)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert collected(got, "node", "component") == sorted(((x, root(x)) for x in parent), key=str)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def line_truth(docs):
    """Text left in each document, and the lines removed, when each component keeps its first line."""
    places = [(i is None, i, k, x) for i, t in docs for k, x in enumerate((t or "").split("\n")) if brute.WORD.search(x)]
    distinct = list({x for *_, x in places})
    sets = [brute.line_shingles(x) for x in distinct]
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    of = {x: root(k) for k, x in enumerate(distinct)}
    first = {}
    for p in sorted(places, key=lambda p: (p[0], p[1] or 0, p[2])):
        first.setdefault(of[p[3]], p[:3])
    out = {}
    for i, t in docs:
        kept = [x for k, x in enumerate((t or "").split("\n")) if not brute.WORD.search(x) or first[of[x]] == (i is None, i, k)]
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(WORDS) for _ in range(14)) for _ in range(25)]
    docs = []
    for i in range(120):
        own = []
        for _ in range(5):
            w = rng.choice(base).split()
            if rng.random() < 0.6:
                w[rng.randrange(14)] = rng.choice(WORDS)
            own.append(" ".join(w))
        docs.append((i, "\n".join([*own, "", " ".join(rng.choice(WORDS) for _ in range(9))])))
    docs += [(200, None), (201, ""), (202, "  \n\t"), (203, "ok"), (204, "ok\nok"), (None, docs[0][1])]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = line_truth(docs)
    right = sum(got[i]["kept_text"] == t for i, t in want.items())
    assert right >= 0.97 * len(want)  # banding finds nearly all links
    assert got[200]["kept_text"] == "" and got[203]["kept_text"] == "ok" and got[204]["n_removed"] == 2 and got[None]["kept_text"].strip() == ""
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_and_unspaced_lines_are_linked(spark):
    """Each pair differs by one edit and is similar by all shingles; no line has more than a few blanks."""
    rng = random.Random(12)
    token = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(71))
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(44))
    two = [(f"{a}ingtonshire {b}berryfields", f"{a}ingtonshire {b}berryfieldz") for a in WORDS[:5] for b in WORDS[5:9]]
    pairs = [
        (chinese, "\u4e8c" + chinese[1:]),
        (token, "#" + token[1:]),
        ("https://quirefold.example.org/a/page", "http://quirefold.example.org/a/page"),
        ("page 17 of the whole book", "page 17 of the whole books"),
        ("abcdef", "abcdefg"),
        ("-" * 300, "-" * 400),
        ("01" * 500, "10" * 700),
        *two,
    ]
    docs = [(2 * k + side, x) for k, p in enumerate(pairs) for side, x in enumerate(p)]
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == line_truth(docs) and got[1] == got[3] == got[5] == got[7] == ""


def test_recall_by_line_length(spark):
    """Random lines with scattered edits near the threshold, with and without blanks: every short one is found, and nearly every long one."""
    rng = random.Random(21)
    letters = "etaoinshrdlucmfwygpb"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    kinds = [(lambda n=n: word(n), 1 if n <= 40 else 0.97) for n in (12, 24, 40, 80, 240)]
    kinds += [(lambda n=n: " ".join(word(rng.randint(n - 2, n + 2)) for _ in range(200 // n)), 0.97) for n in (3, 6, 13)]
    docs, least = [], []
    for make, share in kinds:
        for _ in range(100):
            a = make()
            b = a
            for at in rng.sample(range(len(a)), len(a)):
                c = b[:at] + "X" + b[at + 1 :]
                s, t = brute.line_shingles(a), brute.line_shingles(c)
                if 100 * len(s & t) < 75 * len(s | t):
                    break
                b = c
            docs += [(len(docs), a), (len(docs) + 1, b)]
        least.append(share)
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {i: t for k in range(0, len(docs), 200) for i, t in line_truth(docs[k : k + 200]).items()}
    for k, share in enumerate(least):
        own = range(200 * k, 200 * (k + 1))
        assert sum(got[i] == want[i] for i in own) >= share * 200, k


def test_long_bands_are_compared_in_full(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(k) for k in range(40)]
    docs = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(30, 40)] = f"new{i}"
        docs.append((i, " ".join(w)))
    # Lines that share a long passage and nothing else, in pairs of near copies.
    for i in range(40):
        own = [*base[:8], *(f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(30))]
        docs += [(1000 + 2 * i, " ".join(own)), (1001 + 2 * i, " ".join([*own[:-1], "end"]))]
    monkeypatch.setattr(lines, "HOT", 4)
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["n_removed"] == 0} == {0, *range(1000, 1080, 2)}


def test_bands_are_sets_of_lines_that_stand_once(spark, monkeypatch):
    """Blocks of few values, and values of many lines spread over buckets: a band for each set of lines, and the links of brute force."""
    rng = random.Random(41)
    phrase = " ".join(rng.choice(WORDS) + str(k) for k in range(12))
    docs = []
    for i in range(40):
        own = f"{phrase} " + " ".join(f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(20))
        docs += [(3 * i, own), (3 * i + 1, own + " end"), (3 * i + 2, f"row {i % 9} of the book {rng.randrange(100)}")]
    for name, value in (("SEND", 64), ("FREQUENT", 2), ("LEAST_BUCKETS", 5), ("HOT", 6)):
        monkeypatch.setattr(lines, name, value)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    table = lines._rows(rows, "doc_id", "text").mapInArrow(lines._read_lines, lines._TABLE)
    bands = [r["lines"] for r in lines._bands(table).collect()]
    assert bands and len(bands) == len(set(bands)) and all(len(x) >= 16 for x in bands)
    assert {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(rows).collect()} == line_truth(docs)


def test_lines_that_differ_much_are_not_compared_in_full(spark, monkeypatch):
    """In a band across components, all shingles are compared only where the least ones agree; links at the threshold stay."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(6))
    phrase, texts = " ".join(word() for _ in range(6)), []
    for _ in range(15):
        own = [word() for _ in range(30)]
        near = list(own)
        for at in rng.sample(range(30), 3):
            near[at] = word()
        texts += [" ".join([phrase, *own]), " ".join([phrase, *near])]
    calls, real = [], np.intersect1d
    monkeypatch.setattr(lines.np, "intersect1d", lambda *a, **k: calls.append(1) or real(*a, **k))
    ids = list(range(len(texts)))
    of = lambda x, kind: pa.array(x, kind)
    table = pa.table({"line_id": of([*ids, None], pa.int64()), "component": of([*ids, None], pa.int64()), "line": of([*texts, None], pa.string()), "lines": of([*[None] * len(ids), np.array([-1, *ids]).tobytes()], pa.binary())})
    got = {tuple(sorted(p)) for p in zip(*lines._within(table).to_pydict().values(), strict=True)}
    sets = [brute.line_shingles(x) for x in texts]
    want = {(a, b) for b in ids for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert got == want and len(want) >= 10 and len(calls) <= 60


def test_line_dedup_of_odd_rows(spark):
    """Repeated rows, columns of clashing names, one very long line, and a text of very many lines."""
    rng = random.Random(31)
    long = " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(40_000))
    many = "\n".join(f"line number {k} of {rng.randrange(10**9)} in a text of very many lines" for k in range(3000))
    docs = [(1, long, 1, "x"), (1, long, 1, "x"), (2, f"{long} end", 1, "x"), (3, many, 1, "x"), (3, "other text\nof the same id", 1, "x"), (None, None, None, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, line_id int, band string").selectExpr("*", "text AS line", "1 AS gone", "1 AS text_hash", "1 AS _residue")
    got = lines.dedup_lines(rows).collect()
    assert sorted((r["doc_id"] or 0, r["n_lines"]) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 2), (3, 3000)]
    assert [r["kept_text"] for r in got if r["doc_id"] == 2] == [""] and all(r["kept_text"] == long for r in got if r["doc_id"] == 1)


def test_line_dedup_over_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["kept_sha256"] for r in queries.op7_line_dedup(spark, SF).collect()}
    want = line_truth(docs)
    assert sum(got[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()) >= 0.99 * len(want)


def test_leaks(spark):
    rng = random.Random(4)
    make = lambda n: [rng.choice(WORDS) + rng.choice(WORDS)[:3] + str(rng.randrange(50)) for _ in range(n)]
    items = [(k, " ".join(make(n))) for k, n in enumerate((40, 25, 14, 12, 8, 5, 3))] + [(7, None), (8, "")]
    noise = lambda n: " ".join(make(n))

    def damaged(text, every):
        w = text.split()
        return " ".join(f"sub{k}" if k % every == every - 1 else x for k, x in enumerate(w))

    docs = [(k, f"{noise(30)} {t} {noise(20)}") for k, t in items[:7]]
    docs += [(10, f"{noise(9)} {damaged(items[0][1], 8)} {noise(9)}"), (11, items[1][1].upper().replace(" ", ", ")), (12, noise(400)), (13, None), (14, ""), (15, f"{noise(5)} {damaged(items[0][1], 2)} {noise(5)}"), (None, items[2][1]), (12, items[3][1])]
    got = decontaminate.find_leaks(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, key string"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, key string"))
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert pairs == {(k, k) for k in range(6)} | {(10, 0), (11, 1), (None, 2), (12, 3)}
    assert got.where("doc_id = 12").count() == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.find_leaks(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), empty.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_quotes_of_part_of_an_item_are_leaks(spark):
    words = [f"item{k}" for k in range(60)]
    other = [f"other{k}" for k in range(30)]
    docs = [(n, " ".join([*other, *words[20 : 20 + n], *other])) for n in (11, 13, 15, 18, 21)] + [(100, " ".join(words[20:33])), (200, " ".join([*other, *words[20:26], *other]))]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert collected(got, "doc_id") == sorted([(k,) for k in (11, 13, 15, 18, 21, 100)], key=str)


def test_short_items_and_scripts_without_blanks(spark):
    """Items of 5 to 10 words with as many substitutions as the similarity admits, whole tiny items, and Chinese."""
    rng = random.Random(6)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(10**6))
    items, docs, want = [], [], set()
    for n in range(5, 11):
        text = [word() for _ in range(n)]
        items.append((n, " ".join(text)))
        for at in range(n):
            changed = list(text)
            for k in {at, (at + n // 2) % n} if n >= 8 else {at}:
                changed[k] = word()
            docs.append((100 * n + at, " ".join([word() for _ in range(20)] + changed + [word() for _ in range(20)])))
            want.add((100 * n + at, n))
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    items += [(20, chinese), (21, "yes or no"), (22, "yes")]
    docs += [(1, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(50)) + chinese + "。"), (2, chinese[:30] + "丁" + chinese[31:]), (3, "Yes, or no!"), (4, "we said yes or no to that"), (5, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(90)))]
    want |= {(1, 20), (2, 20), (3, 21)}
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def aligned_share(item, text):
    """Brute force: the largest share of an item's words that stand at their places under any shift of the whole item inside the text."""
    return max((sum(a == b for a, b in zip(item, text[s:], strict=False)) / len(item) for s in range(len(text) - len(item) + 1)), default=0.0)


def test_recall_under_substitutions_against_an_aligner(spark):
    """Every shift of every item is tried by brute force: at least 0.9 of the alignments of 0.75 and more are found, and every row found has one of 0.6 or a verbatim part."""
    rng = random.Random(8)
    vocabulary = [w + x for w in WORDS for x in ("", "s", "ed", "ing")]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.randint(15, 45))]) for k in range(30)]
    docs = []
    for i in range(240):
        _, words = items[i % 30]
        own = [rng.choice(vocabulary) + "x" if rng.random() < rng.choice((0, 0.1, 0.2, 0.25, 0.6)) else w for w in words]
        docs.append((i, [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] + own + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]))
    got = decontaminate.find_leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    shares = {(i, k): aligned_share(item, text) for i, text in docs for k, item in items}
    near = {p for p, share in shares.items() if share >= 0.75}
    assert len(found & near) >= 0.9 * len(near) and len(near) > 100
    assert all(k == i % 30 for i, k in found)


def test_repeated_rows_and_clashing_names_in_decontamination(spark):
    text = " ".join(f"{w}{k}" for k, w in enumerate(WORDS))
    docs = spark.createDataFrame([(1, text, "a", 1), (1, text, "a", 1), (2, "clean words only", "a", 1)], "doc_id long, text string, key string, place int").selectExpr("*", "1 AS item", "1 AS item_id", "'h' AS text_hash")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(7, text), (8, text)], "item_id long, text string"))
    assert collected(found.distinct(), "doc_id", "item_id") == [(1, 7), (1, 8)]


def test_leaks_in_blocks(spark, monkeypatch):
    whole = collected(queries.op8_decontaminate(spark, SF), "doc_id", "item_id", "n_equal", "first_word")
    monkeypatch.setattr(decontaminate, "BLOCK_HASHES", 700)
    assert collected(queries.op8_decontaminate(spark, SF), "doc_id", "item_id", "n_equal", "first_word") == whole and whole


def test_whole_passages_of_the_benchmark_are_found(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d["doc_id"], i["item_id"]) for d in rows for i in items if i["text"] in d["text"]}
    assert want <= {(r["doc_id"], r["item_id"]) for r in queries.op8_decontaminate(spark, SF).collect()}


def test_pipeline(spark):
    """Each stage on its own input against a plain version of its rule."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "decontaminate", "mixing", "token_output"]
    good = stages["quality_rules"](spark, docs, SF).cache()
    kept = {r["doc_id"] for r in good.collect()}
    for i, t in truth.items():
        n, _, symbols, _, repeated = brute.quality(t)
        assert i not in kept or not (n < 20 or 100 * repeated > 30 * n or 10 * symbols > n)
    unique = stages["ngram_jaccard"](spark, good, SF).cache()
    groups = brute.linked_components([(i, truth[i]) for i in kept])
    assert {r["doc_id"] for r in unique.collect()} == {i for i, (_, c) in groups.items() if c == i}
    clean = stages["decontaminate"](spark, unique, SF).cache()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x in r["text"] for r in clean.collect() for x in items)
    assert all(s.columns == docs.columns for s in (good, unique, clean))
    mixed = stages["mixing"](spark, clean, SF).cache()
    times = defaultdict(int)
    for r in mixed.collect():
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in clean.collect()} and mixed.columns == docs.columns
    out = stages["token_output"](spark, mixed, SF).orderBy("start").collect()
    assert len(out) == mixed.count() and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(out, out[1:], strict=False))
    whole = corpus_pipeline.run(spark, SF)
    assert collected(whole, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out), key=str)


def test_pipeline_passes_columns_of_any_name_and_empty_tables(spark, monkeypatch):
    stages = dict(corpus_pipeline.STAGES)
    rng = random.Random(3)
    texts = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(60)) for _ in range(4)]
    names = "kept measures fail_bits text_hash mix_size mix_times layout row doc_copy".split()
    rows = spark.createDataFrame([(k, t, "s", *(f"{n}{k}" for n in names)) for k, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for name in ("quality_rules", "ngram_jaccard", "decontaminate", "mixing"):
        out = stages[name](spark, rows, SF)
        assert out.columns == rows.columns and out.dtypes == rows.dtypes
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
        assert stages[name](spark, rows.limit(0), SF).count() == 0
    assert stages["token_output"](spark, rows.limit(0), SF).count() == 0


def test_one_id_with_two_texts(spark):
    """Only the near copy of another document goes, not the other text under its id."""
    base = [f"{w}{k}" for k, w in enumerate(WORDS * 2)]
    rows = spark.createDataFrame([(1, " ".join(base), "a"), (2, " ".join([*base, "end"]), "a"), (2, " ".join(f"other{k}" for k in range(30)), "a")], "doc_id long, text string, source string")
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, rows, SF).collect()
    assert sorted((r["doc_id"], r["text"][:5]) for r in kept) == [(1, "alpha"), (2, "other")]


def test_equal_rows_stay_once(spark):
    text = " ".join(f"{w}{k}" for k, w in enumerate(WORDS * 2))
    rows = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, text + " end", "b"), (None, text, "c"), (3, None, "c")], "doc_id long, text string, source string")
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, rows, SF)
    assert collected(kept, "doc_id") == [(1,), (3,), (None,)]
    assert quality.apply_policy(quality.ledger(rows), quality.FULL).where("kept").count() == 4
    assert substring.remove_repeats(rows.select("doc_id", "text")).count() == 5
