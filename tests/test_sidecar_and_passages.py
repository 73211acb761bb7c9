"""Literal expectations for authorized facts and passage answers."""

from pyspark.sql import functions as F

from attestra.operators import measures, passages, sidecar

DECLARED = "fact_id long, source_id string, adapter_id string, schema_sha256 string, scope string, predicate string, value string, span_start int, span_end int"


def test_admission_checks_span_and_authority(spark):
    content = '{"printer":"ready"}'
    sources = spark.createDataFrame([("s", content)], "source_id string, content string").withColumn("source_sha256", F.sha2("content", 256))
    authorities = spark.createDataFrame([("a", "v", ["x"], ["state"])], "adapter_id string, schema_sha256 string, scopes array<string>, predicates array<string>")
    rows = [(1, "s", "a", "v", "x", "state", "ready", 12, 17), (2, "s", "a", "v", "x", "state", "ready", 11, 16), (3, "t", "a", "v", "x", "state", "ready", 12, 17), (4, "s", "a", "v", "y", "state", "ready", 12, 17), (5, "s", "b", "v", "x", "state", "ready", 12, 17)]
    found = sidecar.admit(spark.createDataFrame(rows, DECLARED), sources, authorities)
    assert [r.rejected for r in found.orderBy("fact_id").collect()] == [None, "span_mismatch", "unknown_source", "scope_not_allowed", "unknown_adapter"]
    assert sidecar.collisions(found).count() == 0


def test_replacements_expiry_and_rechecks(spark):
    rows = [(1, "o", None, 0, None), (2, "o", 1, 5, None), (3, "p", 2, 0, None), (4, "q", 99, 0, 10)]
    facts = spark.createDataFrame(rows, "fact_id long, orbit string, supersedes long, valid_from long, valid_until long")
    assert {(r.fact_id, r.lineage) for r in sidecar.active(facts).collect()} == {(2, "ok"), (3, "foreign_orbit"), (4, "unknown_fact")}
    assert {r.fact_id for r in sidecar.active(facts, 12).collect()} == {2, 3}
    answers = spark.createDataFrame([("k", "resolved", "v", "", "r", [4]), ("m", "resolved", "w", "", "r", [2])], "key string, state string, value string, unit string, reason string, fact_ids array<long>")
    assert {(r.key, r.state, r.value) for r in sidecar.recheck(answers, facts, 12).collect()} == {("k", "abstain", None), ("m", "resolved", "w")}
    listed = spark.createDataFrame([("o", [2])], "orbit string, fact_ids array<long>")
    assert {(r.orbit, r.complete) for r in sidecar.complete(sidecar.active(facts), listed, ["orbit"]).collect()} == {("o", True), ("p", False), ("q", False)}


def _atoms(spark, *texts):
    return measures.atoms(spark.createDataFrame([(k, t, "g") for k, t in enumerate(texts, 1)], "fact_id long, text string, g string"), ["g"])


def test_numbers_with_units_and_their_flags(spark):
    rows = _atoms(spark, "I ran 3 miles and then 5 miles.", "Maybe it was 9 miles.", "It cost $1,250.50.", "No unit 7 here", None)
    found = [(r.fact_id, str(r.value.normalize()), r.unit, r.hedged) for r in rows.orderBy("fact_id", "position").collect()]
    assert found == [(1, "3", "mile", False), (1, "5", "mile", False), (2, "9", "mile", True), (3, "1250.5", "USD", False)]


def test_hedges_make_a_sum_abstain_and_units_convert(spark):
    rows = measures.convert(_atoms(spark, "It took 2 hours.", "It took 30 minutes."), "minute")
    assert measures.settle_sum(rows, ["g"], "minute").first().value == "150"
    hedged = measures.convert(_atoms(spark, "It took 2 hours.", "Perhaps 30 minutes."), "minute")
    assert measures.settle_sum(hedged, ["g"], "minute").first().state == "abstain"
    assert measures.convert(_atoms(spark, "It took 2 months."), "day").count() == 0


def test_sums_must_agree_under_every_threshold(spark):
    rows = measures.convert(_atoms(spark, "The camping trip took 3 days.", "The camping holiday took 5 days."), "day")
    assert measures.convergent_sum(rows, ["camping"], ["g"]).first().value == "8"
    assert measures.convergent_sum(rows, ["camping", "trip"], ["g"]).first().state == "contested"


def test_money_of_a_class(spark):
    rows = _atoms(spark, "The bike helmet cost $250.", "Another bike ride cost $600.", "The bike helmet cost $250.", "The car cost $9.")
    r = passages.classed_sum(rows, ["g"], ["bike"]).first()
    assert (r.state, r.value, r.unit, r.atoms) == ("resolved", "850", "USD", 2)
    mixed = rows.withColumn("unit", F.when(F.col("fact_id") == 2, "EUR").otherwise(F.col("unit")))
    assert passages.classed_sum(mixed, ["g"], ["bike"]).first().state == "contested"


def test_lists_years_and_absence(spark):
    lists = spark.createDataFrame([("a", "two cats, a dog and three birds"), ("a", "two cats, a dog and three birds"), ("b", "some cats and a dog")], "k string, said string")
    assert {(r.k, r.state, r.value) for r in passages.coordinated_count(lists, ["k"], "said").collect()} == {("a", "resolved", "6"), ("b", "abstain", None)}
    docs = spark.createDataFrame([("a", "She started studying in 2011. She graduated in 2015."), ("b", "He started in 2011 and 2012. He graduated in 2015.")], "k string, text string")
    assert {(r.k, r.state, r.value) for r in passages.year_interval(docs, ["k"], ("started",), ("graduated",)).collect()} == {("a", "resolved", "4"), ("b", "abstain", None)}
    names = spark.createDataFrame([("studying",), ("zebra",)], "identifier string")
    assert {(r.identifier, r.absent) for r in passages.absent(docs, names).collect()} == {("studying", False), ("zebra", True)}
