from dataclasses import dataclass

import pytest

from quirefold.operators import enrichment as en
from quirefold.operators import statements as st
from quirefold.plans import executor, questions

TEXTS = (
    ("r1", 1, "North Park", "Peru", "[Page 1]\nNorth Park was nominated for the Green List. It straddles the border between Peru and Chile.\n[Page 2]\nThe team completed the first survey in 1994. The old oak is estimated at 1,200 years old."),
    ("r2", 2, "South Park", "Peru", "[Page 3]\nSouth Park does not straddle the border. South Park is the deepest canyon of its country. It is a shared transboundary reserve spanning Peru and Brazil. Members completed the first crossing in 1999."),
    ("r3", 3, "West Park", "Chile", "[Page 5]\nWest Park is tentative on the Green List. It is formally paired since 2001 with Alto across the Chile-Peru border. It is deeper compared with South Park. Starting as a farm in 1901, the West Park grew."),
)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([("d", r, o, t, g, o, o, x) for r, o, t, g, x in TEXTS], "document_id string, record_id string, ordinal int, title string, grp string, page_start int, page_end int, text string")


@pytest.fixture(scope="module")
def sentences(records):
    return st.record_sentences(records).cache()


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([("d", f"r{k}", k, "founded", float(y), "visitors", 1) for k, y in ((1, 1990), (2, 1980), (3, 1970))], "document_id string, record_id string, ordinal int, field string, value double, label string, page int")


def test_sentences_know_their_page(sentences):
    got = {(r["record_id"], r["page"]) for r in sentences.collect()}
    assert got == {("r1", 1), ("r1", 2), ("r2", 3), ("r3", 5)}
    assert sentences.count() == 12


def test_status(sentences, facts):
    stated = st.with_status(sentences, ["nominated", "inscribed"], ["tentative", "nominated", "inscribed"], "Green List")
    assert [(r["record_id"], r["status"]) for r in stated.collect()] == [("r1", "nominated")]
    assert [r["record_id"] for r in st.extremum_with_status(facts, stated).collect()] == ["r1"]


def test_events_and_years(sentences, facts):
    got = st.event_distances(sentences, facts, "completed the first", "founded").orderBy("rk").collect()
    assert [(r["title"], r["diff"], r["margin"]) for r in got] == [("North Park", 4, 15), ("South Park", 19, None)]
    assert [r["field"] for r in st.year_fields(facts).collect()] == ["founded"]


def test_relations_need_every_part(sentences):
    patterns = {"straddling": r"(?i)straddl\w*\s+the\s+border", "shared": r"(?i)shared\s+transboundary.+?spanning", "paired": r"(?i)formally\s+paired"}
    row = st.relations(sentences, patterns, {"straddling": r"(?i)does\s+not\s+straddl"}).first()
    assert (row["straddling"]["record_id"], row["shared"]["record_id"], row["paired"]["record_id"]) == ("r1", "r2", "r3")
    assert st.relations(sentences.where("record_id <> 'r3'"), patterns).count() == 0


def test_needles(sentences):
    age = st.needle(sentences, "age", "old oak").first()
    assert age["age"] == "1,200" and age["page"] == 2
    start = st.needle(sentences, "origin", "west park").first()
    assert (start["origin"], start["year"]) == ("a farm", "1901") and st.needle(sentences, "age", "elm").count() == 0


def test_claims_and_comparisons(sentences):
    claimed = st.claims(sentences, "deepest|largest")
    assert [(r["record_id"], r["scope"]) for r in claimed.collect()] == [("r2", "group")]
    assert [(r["claim_id"], r["peer_id"]) for r in st.explicit_comparisons(sentences, claimed).collect()] == [("r2", "r3")]
    said = {
        "a": "Lake A is the deepest lake in the world.", "b": "Norway's deepest lake is here.", "c": "It is not the deepest of all.", "d": "It may be the deepest of all.", "e": "One of the deepest lakes of its country.",
        "f": "It is the deepest part of the bay.", "g": "It is the deepest.", "h": "It is the deepest lake in Chile.",
    }
    rows = sentences.sparkSession.createDataFrame([("d", k, i, k, "Chile" if k == "h" else "Peru", 1, 0, s) for i, (k, s) in enumerate(said.items())], "document_id string, record_id string, ordinal int, title string, grp string, page int, place int, sentence string")
    assert {r["record_id"]: r["scope"] for r in st.claims(rows, "deepest").collect()} == {"a": "universal", "b": "group", "g": "unknown", "h": "group"}


@dataclass
class Stub:
    """What executors ask of a registry."""

    records: object
    facts: object


@pytest.fixture(scope="module")
def parks(spark):
    texts = {
        1: ("North Park", "Peru", "North Park is the largest park in the world. It was inscribed on the list. The \"first winter\" was in 1994."),
        2: ("South Park", "Peru", "South Park is the largest park in its country. It is listed as nominated. The first winter was in 1990."),
        3: ("West Park", "Chile", "West Park is the largest park of Chile. It straddles the border. Its first winter fell in 2001. West Park opened as a farm in 1901."),
        4: ("East Park", "Chile", "East Park is small compared with South Park. It is shared by two nations and twinned with West Park. The oak is thought to be 900 years old."),
    }
    records = spark.createDataFrame([("d", f"r{k}", k, t, g, k, k, f"[Page {k}]\n{x}") for k, (t, g, x) in texts.items()], "document_id string, record_id string, ordinal int, title string, grp string, page_start int, page_end int, text string")
    values = {1: (500.0, 1990.0), 2: (300.0, 1980.0), 3: (900.0, 1970.0), 4: (100.0, 1999.0)}
    facts = [("d", f"r{k}", k, texts[k][0], texts[k][1], f, f, v, str(v), "", "", k, "") for k, pair in values.items() for f, v in zip(("park_area", "year_founded"), pair, strict=True)]
    return Stub(records, spark.createDataFrame(facts, "document_id string, record_id string, ordinal int, title string, grp string, field string, label string, value double, raw_value string, unit string, subject string, page int, quote string"))


def test_executors_of_statements(parks):
    ask = lambda run, **kw: run(questions.Plan("q", "?", **kw), parks)
    refuted = ask(executor.claim_conflict, shape="claim_conflict", field="park_area", direction="max").collect()
    assert {(r["title"], r["rk"]) for r in refuted} == {("North Park", 1), ("South Park", 1), ("South Park", 2)}
    assert all("West Park" in r["quote"] for r in refuted if r["title"] == "North Park") and all("North Park" in r["quote"] for r in refuted if (r["title"], r["rk"]) == ("South Park", 1))
    assert {r["title"] for r in ask(executor.claim_conflict, shape="claim_conflict", direction="max").where("rk = 1").collect()} == {"North Park", "South Park"}  # bound by its words to the record's own field
    dated = ask(executor.dated_comparison, shape="dated_event", phrase="first winter").orderBy("rk").collect()
    assert [(r["title"], r["value"]) for r in dated] == [("North Park", 4.0), ("South Park", 10.0)]
    assert ask(executor.dated_comparison, shape="dated_event") is None
    assert [(r["rk"], r["title"]) for r in ask(executor.cross_border, shape="relation").orderBy("rk").collect()] == [(1, "West Park"), (2, "East Park"), (3, "East Park")]
    assert ask(executor.needle, shape="needle", kind="origin", phrase="West Park").first()["value"] == 1901.0
    assert ask(executor.needle, shape="needle", kind="age", phrase="oak").first()["value"] == 900.0
    held = ask(executor.status_extremum, shape="extremum", field="park_area", direction="max", statuses=("inscribed", "nominated")).orderBy("rk").collect()
    assert [r["title"] for r in held] == ["North Park", "South Park"]


def test_questions_reach_their_executors():
    catalog = questions.Catalog(("park_area", "year_founded"), ("Peru", "Chile"), "park", ("inscribed",))
    plan = lambda q: questions.compile_question("q", q, catalog)
    assert (plan('Which park\'s "first winter" lies closest to the year it was founded?').shape, plan('Which park\'s "first winter" lies closest to the year it was founded?').phrase) == ("dated_event", "first winter")
    assert plan("Which parks straddle a border, are shared between nations, or are twinned?").shape == "relation"
    assert (plan("What did West Park begin as?").kind, plan("How old is the oak of East Park?").phrase) == ("origin", "East Park")
    assert plan("Which inscribed park has the largest area?").statuses == ("inscribed",)


def test_topics(spark, records):
    topics = spark.createDataFrame([("q", "d", "r1", "poaching", "mention_only", "a hunt", 1), ("q", "d", "r2", "poaching", "substantive", "illegal hunting here", 3), ("q", "d", "r2", "poaching", "none", "", 3)], "question_id string, document_id string, record_id string, topic string, level string, exact_quote string, page int")
    guarded = topics.withColumn("level", st.guarded_level(topics["topic"], topics["level"], topics["exact_quote"], {"poaching": ["poach", "illegal hunt"]}))
    assert sorted(r["level"] for r in guarded.collect()) == ["none", "none", "substantive"]
    assert [r["title"] for r in st.topic_examples(topics, records).collect()] == ["South Park"]
    assert sorted(r["level"] for r in st.merged_levels(topics).collect()) == ["mention_only", "substantive"]


def test_names_and_identifiers(spark, records):
    assert [r["record_id"] for r in records.where(st.named_by("How deep is Southern canyon?", records["title"])).collect()] == ["r2"]
    df = spark.createDataFrame([("see 1.2 and 1.22",), ("see 1.22",)], "t string")
    assert [r[0] for r in df.select(st.identifier_exists(df["t"], "1.2")).collect()] == [True, False]


def test_evaluation(spark):
    items = spark.createDataFrame([("a", "COUNT", "12", ["twelve", "bases"]), ("b", "FILTER_LIST", "X, Y", None), ("c", "ARGMAX", "4,102 m", None), ("d", "ABSENCE", "snow", None), ("e", "COUNT", "3", None)], "question_id string, question_type string, reference_answer string, required_key_points array<string>")
    answers = spark.createDataFrame([("a", "12 bases"), ("b", "x, z"), ("c", "It is 4105 m"), ("d", "Snow is absent.")], "question_id string, answer string")
    got = {r["question_id"]: r for r in st.evaluate(answers, items).collect()}
    assert got["a"]["count_correct"] and got["a"]["key_point_coverage"] == 0.5 and not got["e"]["count_correct"]
    assert (got["b"]["list_precision"], got["b"]["list_recall"]) == (0.5, 0.5) and got["c"]["numeric_correct"] and got["d"]["absence_correct"]


class Profiler:
    def profile(self, record, vocabulary):
        return {"name": record["text"].split()[2] + " " + record["text"].split()[3], "category": "Peru", "facts": [{"metric": "Oak age", "value": "1,200", "unit": "years", "quote": "The old oak is estimated at 1,200 years old."}, {"metric": "Made up", "value": "7", "quote": "not in the text"}]}


def test_profiles_are_proved(spark, records, facts):
    proposals = en.profile_records(records, Profiler).cache()
    proved = proposals.where("field IS NOT NULL").collect()
    assert [(r["record_id"], r["field"], r["value"], r["page"]) for r in proved] == [("r1", "oak_age", 1200.0, 2)]
    assert {r["record_id"]: r["grp"] for r in proposals.collect()}["r3"] == "Peru"
    old = facts.selectExpr("document_id", "record_id", "field", "label", "value", "'' AS unit", "page", "'' AS quote")
    assert en.merged_facts(old, proposals).count() == 4
    bare = records.selectExpr("document_id", "record_id", "ordinal", "concat('Record ', ordinal) AS title", "'' AS grp", "text")
    assert {r["record_id"]: r["title"] for r in en.renamed_records(bare, proposals).collect()}["r2"] == "South Park"
    assert en.needs_profiling(bare, facts) and not en.needs_profiling(records, facts)
    assert en.spread_sample(records, 2).count() == 2 and en.induced_vocabulary(proposals).count() == 0


def test_contents_are_proved(spark):
    proposed = spark.createDataFrame([("d", "boxes", "1.1"), ("d", "boxes", "9.9"), ("d", "figures", "2.1")], "document_id string, category string, identifier string")
    source = spark.createDataFrame([("d", "BOXES 1.1 A FIGURES 2.1 B")], "document_id string, contents_text string")
    listed = lambda n: spark.createDataFrame([("d", "boxes", n)], "document_id string, category string, n_listed int")
    assert {(r["identifier"], r["trusted"]) for r in en.proved_contents(proposed, source, listed(1)).collect()} == {("1.1", True), ("2.1", True)}
    assert not en.proved_contents(proposed, source, listed(3)).first()["trusted"]
