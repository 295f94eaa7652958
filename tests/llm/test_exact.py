"""Operators against plain Python versions on sf0.001, and their defined results for odd rows."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quirefold.llm import chat, jaccard, mixing, quality, queries, secrets, substring, token_counts, token_files

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, bucket int, n int, key string"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, PASSAGE, "en", "b", 1), (5, f"before {PASSAGE} after", None, "b", 1),
    (5, f"before {PASSAGE} after", None, "b", 1), (None, f"other start {PASSAGE}", "en", None, 1), (None, None, None, None, None), (7, LONG, "en", "c", 1), (8, "one two", "en", "c", 1), (9, "One TWO", "en", "c", 1),
    (5, "a different text under the same id", "en", "b", 1), (11, "É\x00 ﬁ 日本語 😀 \\l<turn>", "xx", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, "k") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_substring_dedup(spark, rows, odd):
    got = queries.op1_substring_dedup(spark, SF)
    want = [(i, n, gone, brute.sha(kept)) for (i, *_), (n, gone, kept) in zip(rows, brute.substring_dedup([t for _, t, _ in rows], 35), strict=True)]
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
    got = substring.remove_repeats(odd, width=35)
    want = [(r[0], *x) for r, x in zip(ODD, brute.substring_dedup([r[1] for r in ODD], 35), strict=True)]
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=str)
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def test_buckets_of_a_frequent_phrase_are_split(spark, monkeypatch):
    """One phrase in all documents, with other words around: its bucket is split, and equal windows still meet."""
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", 40)
    monkeypatch.setattr(substring, "LEAST_BUCKETS", 3)
    texts = [" ".join([*(f"a{k % 5}b{j}" for j in range(8)), "the phrase that all texts hold", *(f"c{k % 7}d{j}" for j in range(8))]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert collected(substring.remove_repeats(docs, width=9), "doc_id", "n_removed", "kept_text") == sorted([(i, n, kept) for i, (_, n, kept) in enumerate(brute.substring_dedup(texts, 9))], key=str)


def test_windows_inside_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c a b c a b c d"), (2, "x y")], "doc_id long, text string")
    assert collected(substring.remove_repeats(docs, width=3), "n_removed", "kept_text") == sorted([(n, kept) for _, n, kept in brute.substring_dedup(["a b c a b c a b c d", "x y"], 3)], key=str)


def test_token_counts(spark, rows, odd):
    encoder = token_counts.load(queries.tokenizer_path("piece_bpe_32k.model"))
    want = lambda rs: sorted(((i, len((t or "").encode()), n := len(encoder.encode(t or "")), n > 4096) for i, t, *_ in rs), key=str)
    assert collected(queries.op2_token_counts(spark, SF), "doc_id", "n_bytes", "n_tokens", "over_limit") == want(rows)
    small = token_counts.count_tokens(odd, queries.tokenizer_path("piece_bpe_32k.model"), chunk=1000, overlap=8)
    assert collected(small, "doc_id", "n_bytes", "n_tokens", "over_limit") == want(ODD)


def test_chunks_without_a_boundary_widen(spark):
    texts = ["x" * 5000, "ab " * 40 + "y" * 3000 + " cd" * 40, " ".join("é😀" for _ in range(2000))]
    encoder = token_counts.load(queries.tokenizer_path("piece_bpe_32k.model"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_counts.count_tokens(docs, queries.tokenizer_path("piece_bpe_32k.model"), chunk=500, overlap=16)
    assert collected(got, "doc_id", "n_tokens") == [(k, len(encoder.encode(t))) for k, t in enumerate(texts)]


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "x ▁y", "<s> a </s>", "日本 語", "\x00 a", "a\tb\nc"])
def test_counter_matches_the_library(text):
    encoder = token_counts.load(queries.tokenizer_path("piece_bpe_32k.model"))
    assert token_counts.Counter(encoder).count(text) == len(encoder.encode(text))


@pytest.mark.parametrize("text", ["", " ", "a  b", "a.\nb", "a \nb", "a\n\nb", "it's 's", "x²y ²", "a b", "<|endoftext|> x<|endoftext|>\n<|endoftext|> y", "né.e 1a a1b2", "\x1c \x1d a"])
def test_encoder_matches_the_library(text):
    encoder = token_files.Encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    assert encoder.cuts and encoder.encode(text) == encoder.plain(text)


def test_memos_are_bounded_by_parameter():
    encoder = token_files.Encoder(queries.tokenizer_path("byte_bpe_50k.json"), memo=8)
    for text in 2 * [" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))]:
        assert encoder.encode(text) == encoder.plain(text) and len(encoder.spaced) <= 8 and len(encoder.bare) <= 8
    assert len(encoder.spaced)


def test_elias_fano():
    import numpy as np

    for values in ([], [0], [3, 3, 3, 90_000_000], sorted(np.random.default_rng(1).integers(0, 10**6, 3000))):
        coded = token_files.EliasFano(token_files.EliasFano.encode(np.array(values, np.uint64)))
        assert list(coded.values()) == list(values) == [coded.select(k) for k in range(len(values))]


def test_token_files(spark, rows, odd, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    assert collected(queries.op9_token_files(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(((i, *x) for i, x in brute.token_ids(tokenizer, [(i, t) for i, t, _ in rows], 2).items()), key=str)
    token_files.write_token_files(odd, f"file://{tmp_path}/odd", queries.tokenizer_path("byte_bpe_50k.json"), 2, segment_ids=64)
    got = token_files.read_documents(spark, f"file://{tmp_path}/odd").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in ODD), key=lambda i: -1 if i is None else i)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))
    token_files.write_token_files(odd.limit(0), f"file://{tmp_path}/none", queries.tokenizer_path("byte_bpe_50k.json"), 2)
    assert token_files.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_mixing(spark, rows, odd):
    got = queries.op3_mixing(spark, SF).toPandas().set_index("doc_id")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    targets, free, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            targets |= share
            break
        targets |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(targets[s] for s in over)
        free -= over
    taken = defaultdict(int)
    for i, t, s in rows:
        assert got.loc[i, "size"] == len(brute.WORD.findall(t or "")) and got.loc[i, "source_size"] == sizes[s]
        assert got.loc[i, "target"] == pytest.approx(targets[s]) and got.loc[i, "taken"] <= 3 * got.loc[i, "size"]
        taken[s] += got.loc[i, "taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.05 * targets[s] + 10 for s in sizes)
    again = queries.op3_mixing(spark, SF).toPandas().set_index("doc_id")
    assert (again["taken"] == got["taken"]).all()
    mixed = mixing.mix_sources(odd)
    assert mixed.count() == len(ODD) and mixed.where("text is null and mix_size <> 0").count() == 0
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert set(mixing.repeat_documents(mixed, odd.columns).columns) == set(odd.columns)


def test_water_filling_clamps(spark):
    sizes = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), ("c", 500, 1.0), (None, 0, 5.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(sizes, F.lit(1510.0), 3.0).collect()}
    assert got["a"] == 30 and got[None] == 0 and got["b"] == pytest.approx(2 * got["c"]) and sum(got.values()) == pytest.approx(1510)


def test_secrets(spark, rows, odd):
    got = {r["doc_id"]: r for r in queries.op4_secrets(spark, SF).collect()}
    for i, t, _ in rows:
        assert got[i]["base_sha256"] == hashlib.sha256(brute.base_secrets(t or "").encode()).hexdigest()
    assert secrets.scan_secrets(odd).count() == len(ODD) and secrets.scan_secrets(odd.limit(0)).count() == 0


def test_novel_strings_beside_sensitive_words():
    novelty = secrets.Novelty()
    kinds = lambda t: [k for k, *_ in secrets.find_secrets(t, novelty)]
    assert kinds("Authorization header is Bearer qX7tLz09VbNw3KpR5sYe8HdM") == ["novel"]
    assert kinds("the secret of getElementById addEventListener2 configuration") == []
    assert kinds("the password counterrevolutionaries and nothing else") == []
    assert kinds("nothing near qX7tLz09VbNw3KpR5sYe8HdM") == []
    assert kinds('api_key = "abcdef123456"') == ["assign"]


def test_secrets_take_linear_time():
    import time

    novelty = secrets.Novelty()
    for text in ("token " * 170_000, "token" * 200_000, "password=abcdef1 " * 60_000, f"secret {'aB3x' * 250_000}"):
        began = time.thread_time()
        secrets.find_secrets(text, novelty)
        assert time.thread_time() - began < 10


def test_long_documents_are_hashed_in_sections(monkeypatch):
    """Windows and sets of a long text are the same in sections, also where one word spans several."""
    import numpy as np
    import pyarrow as pa

    from quirefold.llm import wordhash as wh

    column = pa.array([LONG, "y" * 9000, "A b c", "", None, "one two three four five six " * 3000 + "z" * 5000 + " end"])
    monkeypatch.setattr(wh, "PIECE_BYTES", 2000)

    def found(section):
        monkeypatch.setattr(wh, "SECTION_BYTES", section)
        powers, windows, out = wh.Powers(wh.BYTE_BASE), wh.Powers(wh.WINDOW_BASE), {}
        data, at = wh.text_bytes(column)
        for first, _, offsets, hashes, before, _ in wh.hashed_pieces(data, at, 35, powers):
            starts, doc = wh.window_starts(offsets, 35)
            out |= {(first + int(d), int(k)): int(x) for x, d, k in zip(wh.window_hashes(hashes, 35, windows)[starts], doc, starts - offsets[doc] + before, strict=True)}
        sets = {first + k: keys[a:z].tolist() for first, edges, keys in jaccard.Shingler(5).sets(column) for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True))}
        return out, sets

    whole, parts = found(1 << 22), found(1500)
    assert whole == parts and len(whole[0]) > 30_000 and np.all(np.diff(whole[1][0]) > 0)


def test_long_texts_lose_the_same_words():
    merged = [[2, 4], [6, 9]]
    text = "  a b c\td e f g h i j k "
    words = text.split()
    assert substring._walk(text, merged) == (11, " ".join(w for k, w in enumerate(words) if not any(a <= k < b for a, b in merged)))
    assert substring._walk(text, []) == (11, " ".join(words)) and substring._walk(" ", []) == (0, "")


def test_keys_that_stand_twice_or_hold_no_digit():
    novelty = secrets.Novelty()
    for key in ("qX7tLz09VbNw3KpR5sYe8HdM", "qXqtLzaGVbNwJKpRTsYeQHdM"):
        text = f"bearer {key} of the first\nbearer {key} of the second"
        assert [text[a:z] for _, a, z in secrets.find_secrets(text, novelty)] == [key, key]
    assert secrets.find_secrets("token of BackgroundWorkerQueueManager here", novelty) == []


def test_jaccard(spark, rows, odd):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_ngram_jaccard(spark, SF).collect()}
    assert got == brute.linked_components([(i, t) for i, t, _ in rows])
    links = defaultdict(int)
    sets = {i: brute.shingles(t) for i, t, _ in rows}
    where = defaultdict(set)
    for i, own in sets.items():
        for g in own:
            where[g].add(i)
    for a, b in {(a, b) for ids in where.values() for a in ids for b in ids if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
    assert {r["doc_id"]: r["n_links"] for r in queries.op5_ngram_jaccard(spark, SF).collect()} == {i: links[i] for i in sets}
    other = jaccard.link_documents(odd).collect()
    assert len(other) == len(ODD)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in other if r["doc_id"] is not None}
    assert by[9, 1] == by[8, 1] == 8 and by[1, 0] == 1 and by[2, 0] == 2
    assert all(r["component_id"] is None for r in other if r["doc_id"] is None)
    assert jaccard.link_documents(odd.limit(0)).count() == 0


def test_jaccard_over_tiles(spark, monkeypatch):
    import random

    monkeypatch.setattr(jaccard, "TILE", 5)
    rng = random.Random(3)
    base = [f"t{k}" for k in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"r{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.linked_components(docs)


def test_quality(spark, rows, odd):
    got = {r["doc_id"]: r for r in queries.op6_quality(spark, SF).collect()}
    for i, t, _ in rows:
        want, r = brute.quality(t), got[i]
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    entries = quality.ledger(odd)
    assert entries.where("text is null and measures.n_words = 0 and fail_bits = 1").count() == 2 and set(odd.columns) < set(entries.columns)
    assert quality.ledger(odd.limit(0)).count() == 0


def test_quality_ablations(spark):
    entries = spark.createDataFrame([(0,), (1,), (2,), (3,), (3,), (4,)], "fail_bits long")
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablations(entries, quality.FULL).collect()}
    assert got["few_words"] == (3, 1) and got["repeated_words"] == (3, 1) and got["symbols"] == (1, 1) and got["upper_case"] == (0, 0)
    assert quality.apply_policy(entries, quality.BASE).where("kept").count() == 2


def test_chat(spark):
    got = {r["conv_id"]: r for r in queries.op10_chat(spark, SF).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    assert set(got) == set(turns)
    for i, own in turns.items():
        loss = "".join(t for _, role, t in sorted(own) if role == "assistant")
        assert (got[i]["n_turns"], got[i]["turns_sha256"]) == (len(own), brute.sha("".join(f"{role}\n{t}\n" for _, role, t in sorted(own))))
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(loss), brute.sha(loss))


def test_chat_layouts(spark):
    records = [
        ('{"messages":[{"content":"a<b>","role":"user"},{"role":"assistant","content":"\\\\l \\\\\\\\"}]}', "messages", [("user", "a<b>"), ("assistant", "\\l \\\\")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":null}]}', "dialogue", [("user", "q"), ("assistant", "")]),
        ('{"instruction":"do","input":"x","output":"y"}', "instruction", [("user", "do\n\nx"), ("assistant", "y")]),
        ('{"instruction":"do","output":"y"}', "instruction", [("user", "do"), ("assistant", "y")]),
        ('{"answer":"b","question":"a"}', "question", [("user", "a"), ("assistant", "b")]),
        ('{"id":7,"tags":["x"],"messages":[{"role":"user","content":"a","weight":0.5,"meta":{"role":"z"}}]}', "messages", [("user", "a")]),
        ('{"meta":{"prompt":"x"},"question":"a","answer":"b","content":1.25}', "question", [("user", "a"), ("assistant", "b")]),
        ('{"meta":{"question":"a","answer":"b"}}', None, None), ('{"messages":["a"]}', None, None),
        ('{"weather":1}', None, None), ("no json", None, None), (None, None, None),
    ]
    df = chat.canonical_turns(spark.createDataFrame([(k, r[0]) for k, r in enumerate(records)], "k int, record string"))
    for r in df.collect():
        _, layout, turns = records[r["k"]]
        assert r["layout"] == layout and (turns is None) == (r["turns"] is None)
        assert turns is None or [tuple(t) for t in r["turns"]] == turns
    read = chat.read_back(chat.format_turns(df)).collect()
    assert len(read) == len(records)
    for r in read:
        turns = records[r["k"]][2]
        assert (r["loss_text"] is None and r["formatted"] is None) if turns is None else [tuple(t) for t in r["read_turns"]] == turns


def test_columns_of_clashing_names_pass_through(spark):
    rows = spark.createDataFrame([(1, '{"prompt":"a","completion":"b"}', "p", "h", "b", "f")], "id int, record string, pieces string, heads string, bodies string, kept string")
    read = chat.read_back(chat.format_turns(chat.canonical_turns(rows))).first()
    assert (read["pieces"], read["heads"], read["bodies"], read["kept"], read["loss_text"]) == ("p", "h", "b", "f", "b")
    docs = spark.createDataFrame([(1, "some words here", "s", 5, 6, 7)], "doc_id long, text string, source string, mix_size int, mix_target int, kept int")
    assert mixing.mix_sources(docs).select("mix_size", "kept").first() == (3, 7)
    empty = rows.limit(0)
    assert chat.read_back(chat.format_turns(chat.canonical_turns(empty))).count() == 0


def test_chat_rows_with_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, None, "user", "")], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_turns(chat.canonical_turns(chat.conversation_records(rows)))).collect()
    assert {(r["conv_id"], len(r["read_turns"]), r["loss_text"]) for r in got} == {(1, 3, ""), (None, 1, "")}
