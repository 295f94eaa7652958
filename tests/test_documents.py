import pytest
from pyspark.sql import functions as F

from quirefold.functions import document as doc
from quirefold.operators import mapper, registry
from quirefold.plans import executor, questions
from quirefold.sources import store
from quirefold.sources import text as source

CARDS = (
    "## Station in numbers\n120\nStaff members\nArea covered (sq km): 45\n1967 Year established",
    "## Station in numbers\nStaff members\n95\nArea covered (sq km): 40.5\n1970 Year established",
    "## Station in numbers\nStaff members: 70 people\n33 Area covered (sq km)\nEstablished\n1988",
    "## Station in numbers\n12\nStaff members\nArea covered (sq km): 80\n2001 Year established",
)
NAMES = (("Alpha Base", "Norway"), ("Beta Base", "Norway"), ("Gamma Base", "Peru"), ("Delta Base", "Peru"))


def stations(listed=4):
    pages = [(1, "Contents\n" + "\n".join(f"{k}. {n}" for k, (n, _) in enumerate(NAMES[:listed], 1)))]
    for k, ((name, country), card) in enumerate(zip(NAMES, CARDS, strict=True)):
        boast = " Alpha Base is the largest station of its country." if name == "Gamma Base" else ""
        pages += [(2 + 2 * k, f"# {name}\nCountry: {country}\nThe base lies far from any town.{boast}"), (3 + 2 * k, card)]
    return pages


@pytest.fixture(scope="module")
def compiled(spark):
    pages = [("doc-a", n, t) for n, t in stations()] + [("doc-b", 1, "Plain prose.\n\nMore prose."), ("doc-b", 4, None)]
    return registry.Registry(registry.compile_documents(spark.createDataFrame(pages, "document_id string, page_number int, text string").repartition(5)).cache())


def test_stations(compiled):
    one = compiled.compiled.where("document_id = 'doc-a'").first()
    assert one["registry_trusted"] and one["entity_label"] == "station"
    assert [(r["title"], r["grp"], r["page_start"], r["page_end"]) for r in one["records"]] == [(n, g, 2 + 2 * k, 3 + 2 * k) for k, (n, g) in enumerate(NAMES)]
    values = {(r["title"], r["field"]): (r["value"], r["unit"]) for r in compiled.facts.collect()}
    assert values["Beta Base", "staff_members"] == (95.0, "") and values["Gamma Base", "area_covered"] == (33.0, "sq km") and values["Gamma Base", "year_established"] == (1988.0, "")
    assert len(values) == 12


def test_every_page_is_in_one_record(compiled):
    held = compiled.mapping_records.select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("p")).groupBy("document_id", "p").count()
    assert held.where("count <> 1").count() == 0


def test_fewer_listed_than_found_is_untrusted():
    found = doc.compile_records(doc.Document(stations(3)))
    assert not found.trusted and any("Contents list" in w for w in found.warnings)


def test_plain_documents_become_segments(compiled):
    own = compiled.records.where("document_id = 'doc-b'").orderBy("ordinal").collect()
    assert [(r["record_id"], r["page_start"], r["page_end"]) for r in own] == [("segment-001", 1, 1), ("segment-002", 4, 4)]


def test_segments_flush_at_gaps_and_size():
    read = doc.Document([(1, "a" * 8000), (2, "b" * 8000), (4, "c" * 100)])
    assert [(r.page_start, r.page_end) for r in doc.packed_segments(read, read.numbers, "segment")] == [(1, 1), (2, 2), (4, 4)]


def test_back_matter_is_no_record():
    pages = []
    for k, name in enumerate(("North Ridge", "South Ridge", "West Ridge")):
        pages.append((k + 1, f"# {name}\ntext\n## Key facts\n{k + 3} Towers"))
    found = doc.compile_records(doc.Document([*pages, (4, "# Index\nNorth 1")]))
    assert found.records[-1].page_end == 3 and [s.page_start for s in found.supplements] == [4]


def test_recurring_headings_cut_chapters():
    pages = []
    for k, name in enumerate(("Old Harbour", "High Moor", "Green Valley")):
        pages += [(2 * k + 1, f"# {name}\nIntro."), (2 * k + 2, "## Stay here\nAn inn.\n## Eat there\nA cafe.")]
    chapters = doc.Cycle(doc.Document(pages)).chapters()
    assert [(c.first, c.last, c.title) for c in chapters] == [(1, 2, "Old Harbour"), (3, 4, "High Moor"), (5, 6, "Green Valley")]


def test_a_spare_card_moves_the_border():
    read = doc.Document([(n, "## Key facts\n5 Towers" if n in (2, 6) else "plain") for n in range(1, 11)])
    cycle = doc.Cycle(read)
    for start, want in ((7, (5, 6)), (10, (9, 10))):
        before, own = doc.Chapter(1, start - 1), doc.Chapter(start, 10)
        cycle._take_cards(before, own)
        assert (before.last, own.first) == want


def test_synonyms_fold_only_when_no_record_states_both():
    fact = lambda f: doc.Fact(f, f, 1.0, "1", "", "", 1, "")
    record = lambda i, *fs: doc.Record(f"r{i}", i, "", "", 1, 1, 1, "", tuple(map(fact, fs)))
    assert doc.fold_synonyms([record(1, "year_established"), record(2, "year_established"), record(3, "established")])[1] == {"established": "year_established"}
    assert doc.fold_synonyms([record(1, "year_established", "established"), record(2, "year_established")])[1] == {}
    assert doc.fold_synonyms([record(1, "approximate_number_of_visitors_annually"), record(2, "million_visitors_per_year")])[1] != {}


def test_group_labels():
    group = lambda t: doc.Document([(1, t)], doc.Vocabulary({"Chile": ("chile", "chilean"), "Peru": ("peru", "peruvian")})).group(t)
    assert group("Country: Uzbekistan\nA sentence") == "Uzbekistan" and group("country: New Zealand") == "New Zealand"
    assert group("the country: over millennia") == "" and group("") == "" and group("PERU\nchile chile chile") == "Peru" and group("Chile's coast, peru peru") == "Chile"


def test_flat_tables():
    names, rows = doc.flat_table("Firms by region Country Number of firms Staff Austria 2 321 410 Belgium 1 200 300 Chile 3 000 - Denmark 900 120 Estonia 150 30 Total 7 571 860 Note: rounded")
    assert names == ["country", "number_of_firms", "staff"] and rows[0] == ("Austria", [2321.0, 410.0]) and rows[2] == ("Chile", [3000.0, None]) and rows[-1][0] == "Total"
    assert doc.flat_table("Shares Country Share Aland 12.5% Bland 3.5% Cland 7% Dland 9% Eland 11%")[1][0][1] == [12.5]
    assert doc.flat_table("In 1990 the town grew and by 2001 it had 12 schools, while in 2010 there were 15.") == ([], [])
    assert doc.flat_table("Table 2.2. Second list 14 Table 2.3. Third list 18 Table 2.4. More 20") == ([], [])


def test_ranked_table_carries_groups():
    head = "TABLE 1 Human Development Index life expectancy gross national income HDI RANK "
    pages = [(10, head + "Very high human development 1 Aland 0.950 80.1 16.0 12.1 50,000 2 Bland 0.940 81.2 .. 11.0 48,000"), (11, "TABLE 1 High human development 3 Cland 0.790 70.0 12.0 9.0 20,000 Other countries or territories Dland .. 99.9")]
    table = doc.compile_tables(pages)[0]
    assert [(r["rank"], r["label"], r["grp"]) for r in table["rows"]] == [(1, "Aland", "Very high human development"), (2, "Bland", "Very high human development"), (3, "Cland", "High human development")]
    assert table["rows"][1]["values"]["expected_schooling_years_2023"] is None and table["trusted"] and table["page_end"] == 11


def test_markdown_tables():
    table = doc.compile_tables([(1, "TABLE 3 Towns\n| Town | People |\n|---|---|\n| A | 1,200 |\n| B | .. |")])[0]
    assert table["columns"] == ["town", "people"] and [(r["label"], r["values"]["people"]) for r in table["rows"]] == [("A", 1200.0), ("B", None)]


def test_contents(spark):
    pages = [("d", 1, "Contents B O X E S 1.1 A box 3 1.2 Another 4 FIGURES S1.1 Fig 5 2.1 Fig two 9 O.1 Map 2"), ("d", 2, "Overview Box 1.1 Figure O.1"), ("d", 3, "Box 1.2 Figure 2.1 and Figure S1.1 again Figure 2.1")]
    made = registry.Registry(registry.compile_documents(spark.createDataFrame(pages, "document_id string, page_number int, text string")))
    assert {(r["category"], r["n"]) for r in registry.contents_counts(made.contents).collect()} == {("boxes", 2), ("figures", 3)}
    chapters = registry.figures_by_chapter(made.contents).orderBy("place").collect()
    assert [(r["chapter"], r["n"]) for r in chapters] == [("Overview", 1), ("1", 1), ("2", 1)]


def test_quotes_and_values():
    text = "[Page 4]\nThe lake is “deep” – very. It is 4,102 m deep.\n[Page 5]\nOther words stand here."
    assert doc.literal_quote(text, 'the lake is "deep" - very.') == ("The lake is “deep” – very.", 4)
    assert doc.literal_quote(text, "not in it at all") is None and doc.literal_quote(text, "lake") is None
    assert doc.value_supported(4102.0, "depth", "It is 4,102 m deep") and not doc.value_supported(410.0, "depth", "It is 4,102 m deep")
    assert doc.value_supported(12.0, "staff_members", "In 1990 it had 12 staff members and 40 boats") and not doc.value_supported(40.0, "staff_members", "In 1990 it had 12 staff members and 40 boats")
    assert doc.value_supported(1.5e6, "visitors", "about 1.5 million visitors")


def test_plans():
    catalog = questions.Catalog(("area_covered", "staff_members", "year_established"), ("Norway", "Peru"), "station")
    plan = lambda q: questions.compile_question("q", q, catalog)
    assert (plan("Which station covers the largest area?").shape, plan("Which station covers the largest area?").field) == ("extremum", "area_covered")
    assert plan("How many stations have more than 90 staff members?").comparator == "gt" and plan("How many stations have at most 90 staff members?").comparator == "lte"
    assert plan("How many stations are in Norway and in Peru?").groups == ("Norway", "Peru")
    assert plan("Which of floods, fires, and storms, which is not reported?").topics[:2] == ("floods", "fires")
    assert plan("How many boxes and figures are in the contents?").categories == ("boxes", "figures")
    assert plan("Tell the story of the place.").strategy == "hierarchical_synthesis"
    base = plan("Tell the story of the place.")
    assert questions.routed(base, {"shape": "count_by_threshold", "confident": True, "field": "staff_members", "threshold": 0}, catalog).threshold == 0
    assert questions.routed(base, {"shape": "extremum", "confident": True, "field": "unknown", "direction": "max"}, catalog) is base
    assert questions.routed(base, {"shape": "extremum", "confident": True, "field": "area_covered"}, catalog) is base


def test_execution(spark, compiled):
    own = registry.Registry(compiled.compiled.where("document_id = 'doc-a'"))
    catalog = executor.catalog_of(own)
    ask = lambda q: executor.execute(questions.compile_question("q", q, catalog), own)
    got = ask("Which station covers the largest area?").orderBy("rk").collect()
    assert [(r["title"], r["value"]) for r in got] == [("Delta Base", 80.0), ("Alpha Base", 45.0), ("Beta Base", 40.5)]
    assert {(r["grp"], r["value"]) for r in ask("How many stations are in Norway and in Peru?").collect()} == {("Norway", 2.0), ("Peru", 2.0)}
    assert {r["title"] for r in ask("How many stations have more than 90 staff members?").where("rk = 1").collect()} == {"Alpha Base", "Beta Base"}
    assert {r["title"] for r in ask("Which claims of area covered conflict with the figures?").collect()} == {"Gamma Base"}
    assert ask("Tell the story of the place.") is None


def test_incomplete_fields_decline(spark, compiled):
    pages = [("x", n, t.replace("Staff members: 70 people\n", "")) for n, t in stations()]
    own = registry.Registry(registry.compile_documents(spark.createDataFrame(pages, "document_id string, page_number int, text string")))
    plan = questions.compile_question("q", "Which station has most staff members?", executor.catalog_of(own))
    assert executor.execute(plan, own) is None


class Failing(mapper.LexicalProvider):
    def read(self, question, record):
        if record["record_id"] == "record-002":
            raise RuntimeError("away")
        return super().read(question, record)


def test_exhaustive_map_and_repair(compiled):
    records = compiled.mapping_records.where("document_id = 'doc-a'")
    plans = [questions.Plan("q1", "Which base lies far from any town?"), questions.Plan("q2", "Which is absent?", "absence", topics=("far from any town", "snow"))]
    first = mapper.map_records(records, plans, Failing).cache()
    assert first.count() == 10 and first.where("status = 'llm_failed'").count() == 2
    whole = mapper.repaired(records, first, plans, mapper.LexicalProvider).cache()
    assert whole.count() == 10 and whole.where("status IN ('llm_failed', 'parse_failed')").count() == 0
    rows = mapper.evidence_rows(whole).where("question_id = 'q1'").collect()
    assert len(rows) >= 4 and all(r["page"] in (2, 4, 6, 8) for r in rows)
    assert [r["topic"] for r in mapper.absence_answer(whole.where("question_id = 'q2'"), 5).collect()] == ["snow"]
    payload = mapper.evidence_payload(mapper.bounded_evidence(mapper.evidence_rows(whole), F.lit(4))).where("question_id = 'q1'").collect()
    assert payload[0]["evidence_id"] == "E001" and payload[0]["position"] == "early"
    assert mapper.fallback_answers(mapper.evidence_rows(whole), lookup=True).where("question_id = 'q1'").first()["answer"].endswith(".")


class Counting(mapper.LexicalProvider):
    """Takes batches, and writes a file for each call."""

    def __init__(self, folder):
        self.folder = folder

    def _called(self):
        import uuid

        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()

    def read_many(self, question, records):
        self._called()
        return {r["record_id"]: self.read(question, r) for r in records}


def test_calls_are_batched_and_only_failed_pairs_come_again(spark, tmp_path):
    import os
    from functools import partial

    records = spark.createDataFrame([("d", f"r{k}", k, f"t{k}", f"[Page {k}]\nThe quiet harbour froze in winter {k}.") for k in (1, 2)], "document_id string, record_id string, ordinal int, title string, text string").coalesce(1)
    plans = [questions.Plan("q1", "Which quiet harbour froze?"), questions.Plan("q2", "Which lonely desert bloomed?")]
    assert mapper.map_records(records, plans[:1], partial(Counting, str(tmp_path))).where("status = 'evidence_found'").count() == 2 and len(os.listdir(tmp_path)) == 1
    results = mapper.map_records(records, plans).withColumn("status", F.when(F.expr("question_id = 'q1' AND record_id = 'r2'"), "parse_failed").otherwise(F.col("status"))).cache()
    results.count()
    again = mapper.map_records(records.withColumn("asked", F.when(F.col("record_id") == "r2", F.array(F.lit("q1"))).otherwise(F.array().cast("array<string>"))), plans)
    assert [(r["question_id"], r["record_id"]) for r in again.collect()] == [("q1", "r2")]
    whole = mapper.repaired(records, results, plans, mapper.LexicalProvider)
    assert whole.count() == 4 and {r["status"] for r in whole.where("question_id = 'q1'").collect()} == {"evidence_found"}
    packet = {r["question_id"]: r for r in mapper.evidence_packet(whole).collect()}
    assert packet["q1"]["n_found"] == 2 and not packet["q1"]["needs_repair"] and packet["q2"]["needs_repair"]


def test_overlooked_records_and_selection(spark):
    texts = ["the usual prose of a long book"] * 9
    texts[4] = "the usual prose on glacier crevasses"
    records = spark.createDataFrame([("d", f"r{k}", k, f"t{k}", x) for k, x in enumerate(texts, 1)], "document_id string, record_id string, ordinal int, title string, text string")
    plans = [questions.Plan("q", "Where are glacier crevasses in the usual prose?")]
    results = mapper.map_records(records, plans).withColumn("status", F.lit("no_evidence"))
    assert [r["record_id"] for r in mapper.overlooked(records, results, plans).collect()] == ["r5"]
    picked = mapper.lexical_selection(records, plans).orderBy("place").collect()
    assert len(picked) == 8 and {min(2, 3 * (r["ordinal"] - 1) // 9) for r in picked} == {0, 1, 2} and picked[0]["record_id"] == "r5"


def test_phrases_are_whole_words(spark):
    from quirefold.operators import evidence as ev

    df = spark.createDataFrame([("other things",), ("the c++ code",), ("a.b",), ("axb",), ("Snow is not discussed here. Ice is.",)], "t string")
    has = lambda phrase, test=ev.has_phrase: [r[0] for r in df.select(test(df["t"], phrase)).collect()]
    assert has("the") == [False, True, False, False, False] and has("C++") == [False, True, False, False, False] and has("a.b") == [False, False, True, False, False]
    assert has("snow") == [False] * 4 + [True] and has("snow", ev.treats_phrase) == [False] * 5 and has("ice", ev.treats_phrase) == [False] * 4 + [True]


def test_written_numbers():
    from quirefold.functions.numbers import written
    from quirefold.plans import run

    assert [written(v) for v in (1234567.0, 15_000_000.0, 0.0, -3.5, 12.38, 1e15)] == ["1234567", "15000000", "0", "-3.5", "12.38", "1000000000000000"]
    row = {"rk": 1, "title": "A", "grp": "", "value": 1234567.0, "page": 3}
    assert run.sentence_of([row], questions.Plan("q", "?", "extremum", direction="max")) == ("A (1234567).", "1234567", [3])


def test_mapped_numbers_fill_gaps(spark):
    facts = spark.createDataFrame([("q", "d", "r1", 1, 5.0, "m")], "question_id string, document_id string, record_id string, ordinal int, value double, unit string")
    evidence = spark.createDataFrame([("q", "d", "r1", 1, "99", "m"), ("q", "d", "r2", 2, "7", "m"), ("q", "d", "r3", 3, "800", "ft"), ("q", "d", "r4", 4, "6", "m")], "question_id string, document_id string, record_id string, ordinal int, value string, unit string")
    assert [r["record_id"] for r in mapper.mapped_extremum(facts, evidence).orderBy("rk").collect()] == ["r2", "r4", "r1"]


def test_page_sources(spark, tmp_path):
    docs = [("m", "lost <!-- page-start-marker-1 -->\none\n<!-- page-start-marker-2 -->\ntwo\n<!-- page-start-marker-1 -->\nagain"), ("v", "a" * 500 + "\n\n" + "b" * 300 + "\f" + "c"), ("e", "x\\ny\\n" * 12)]
    pages = source.split_pages(spark.createDataFrame(docs, "document_id string, text string"), 600)
    got = {(r["document_id"], r["page_number"]): r["text"] for r in pages.collect()}
    assert got["m", 1] == "one" and got["m", 2] == "two" and len(got["v", 1]) == 500 and got["v", 3] == "c" and "\n" in got["e", 1]
    assert "".join(source.virtual_pages("z" * 2000, 600)) == "z" * 2000
    with pytest.raises(ValueError):
        source.virtual_pages("x", 10)
    for name, raw in (("a.txt", "é".encode()), ("b.txt", "한국".encode("cp949")), ("c.txt", "hi".encode("utf-16"))):
        (tmp_path / name).write_bytes(raw)
    assert sorted(r["text"] for r in source.read_text_documents(spark, f"file://{tmp_path}").collect()) == ["hi", "é", "한국"]
    assert source.decode_bytes(b"\xff\xfe\x00") == "ÿþ\x00"  # not UTF-16 after all
    odd = source.split_pages(spark.createDataFrame([("u", "x <!-- PAGE-START-MARKER-3 -->\nthree"), ("p", 'C:\\temp \\"said\\"\\n' * 25)], "document_id string, text string"))
    got = {(r["document_id"], r["page_number"]): r["text"] for r in odd.collect()}
    assert got["u", 3] == "three" and 'C:\\temp "said"\n' in got["p", 1]
    (tmp_path / "pages.json").write_text('{"pages": [{"document_id": "j", "page_number": 2, "text": "t"}]}')
    assert [tuple(r) for r in source.parsed_pages(spark, f"file://{tmp_path}/pages.json").collect()] == [("j", 2, "t")]
    (tmp_path / "pages.json").unlink()
    (tmp_path / "d.md").write_text("no")
    with pytest.raises(Exception, match="no text file"):
        source.read_text_documents(spark, f"file://{tmp_path}").collect()


def test_question_sources():
    assert source.questions_from_text(["q01: x", "", "q02\ty", "plain"]) == [("q01", "x"), ("q02", "y"), ("q04", "plain")]
    assert source.questions_from_json({"questions": [{"id": "a", "text": "t"}]}) == [("a", "t")]
    assert source.question_categories([{"id": "a", "text": "t", "category": "c"}, {"text": "u"}]) == {"a": "c"}
    with pytest.raises(ValueError, match="repeat"):
        source.questions_from_text(["q01: x", "q01: y"])


def test_store_and_submission(spark, tmp_path):
    kept = store.RunStore(spark, f"file://{tmp_path}/store")
    kept.save(spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, n int"), "t")
    kept.save(spark.createDataFrame([("b", 3)], "document_id string, n int"), "t")
    assert sorted((r["document_id"], r["n"]) for r in kept.load("t").collect()) == [("a", 1), ("b", 3)]
    asked = spark.createDataFrame([("q1", 1), ("q2", 2), ("q3", 3)], "question_id string, ordinal int")
    given = spark.createDataFrame([("q1", "yes", None, [3, 4], "note"), ("q2", "Error: down", "42", [], None)], "question_id string, answer string, result_value string, pages array<int>, note string")
    rows = store.submission_rows(asked, given).orderBy("ordinal").collect()
    assert [(r["id"], r["answer"], r["error"]) for r in rows] == [("q1", "yes", None), ("q2", "42", None), ("q3", "", "Pending")]
    assert rows[0]["evidence"] == "note Source pages/segments: 3, 4"
    later = store.upserted(store.submission_rows(asked, given), spark.createDataFrame([("q3", "now", None, [7], None)], "question_id string, answer string, result_value string, pages array<int>, note string"))
    assert [(r["id"], r["answer"], r["error"]) for r in later.orderBy("ordinal").collect()] == [("q1", "yes", None), ("q2", "42", None), ("q3", "now", None)]
    assert kept.load_of("t", ["b"]).count() == 1
    assert store.submission_json(store.submission_rows(asked, given), "t").first()["json"].startswith('{"answers":[{"id":"q1","answer":"yes"}')


def test_streaming_ingest(spark, tmp_path):
    import json

    from quirefold.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps({"document_id": "s1", "text": "Some words.\n\nMore words."}) + "\n")
    kept = store.RunStore(spark, f"file://{tmp_path}/kept")
    ingest.compile_stream(spark, f"file://{tmp_path}/in", kept, f"file://{tmp_path}/cp").awaitTermination(60)
    assert kept.load("compiled").count() == 1


def test_answers_from_end_to_end(spark, compiled):
    from quirefold.plans import run

    own = compiled.compiled.where("document_id = 'doc-a'")
    got = {r["question_id"]: r for r in run.answer_questions(own, [("q1", "Which station covers the largest area?"), ("q2", "Which base lies far from any town?"), ("q3", "Which of far from any town, and snow storms, which is not mentioned?")]).collect()}
    assert got["q1"]["answer"] == "Delta Base (80). The next highest: Alpha Base (45), Beta Base (40.5)." and got["q1"]["result_value"] == "80"
    assert got["q2"]["note"] == "from evidence" and 2 in got["q2"]["pages"] and got["q3"]["answer"] == "snow storms"
    assert run.parse_answer('```json\n{"answer": {"a": 1, "b": ["x", null, "y"]}}\n```') == "a: 1. b: x; y." and run.parse_answer("plain") == "plain"
    assert run.missing_slots("in 1999", ("date", "thesis")) == ["thesis"]


def test_pdf_reading_is_an_extra(spark):
    from quirefold.sources import pdf

    if not pdf.available():
        with pytest.raises(ImportError, match="PyMuPDF"):
            pdf.read_pdf_pages(spark, "/nowhere")
