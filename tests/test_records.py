"""Hand-made tables for scans, cleaning, profiles, cohorts and noise."""
import time

import pytest
from pyspark.sql import functions as F

from kinsift.functions.draws import draw
from kinsift.operators import cleaning, cohort, demographics, perturb, profiling
from kinsift.sources import delimited


def values(df, column):
    return [r[column] for r in df.collect()]


def test_delimited_scan_skips_long_and_pads_short_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x, y",,\n , NA ,z\nq,r,\xe9\n1,2,3,\n')
    df = delimited.read_delimited(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3"), ("4", "5", None), ("x, y", None, None), (" ", " NA ", "z"), ("q", "r", "é")]
    assert df.count() == 5 and df.select("b").count() == 5
    assert values(df.select("c").where("c is not null"), "c") == ["3", "z", "é"]
    assert delimited.read_delimited(spark, str(path), rows=2).count() == 2


@pytest.mark.parametrize("sep,name", [("\t", "t.txt"), (",", "t.csv"), (";", "s.csv"), ("|", "p.csv")])
def test_separators(spark, tmp_path, sep, name):
    path = tmp_path / name
    path.write_text(f"a{sep}b\n1{sep}2\n")
    assert delimited.detect_separator(spark, str(path), delimited.LOADER_SEPARATORS) == sep
    assert delimited.read_delimited(spark, str(path), sep=sep).first().asDict() == {"a": "1", "b": "2"}
    if sep in "\t,":
        assert delimited.read_delimited(spark, str(path)).columns == ["a", "b"]
        assert delimited.detect_separator(spark, str(path)) == sep


def test_one_column_file_is_refused(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("a\n1\n")
    with pytest.raises(ValueError):
        delimited.detect_separator(spark, str(path))


def test_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("1", "a,b"), ("2", None), ("3", 'say "x"')], "id string, t string")
    delimited.write_delimited(df, str(tmp_path / "out"))
    back = delimited.read_delimited(spark, str(tmp_path / "out"), sep=",")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_field_names():
    assert cleaning.clean_name("  First--Name (2)! ") == "first_name_2"


def test_field_name_collisions(spark):
    df, changed = cleaning.clean_field_names(spark.createDataFrame([(1, 2, 3)], ["A b", "a_b", "c"]))
    assert df.columns == ["a_b", "a_b_2", "c"] and changed == {"A b": "a_b", "a_b": "a_b_2"}


def test_sparse_rows(spark):
    rows = [(None,) * 5, ("a", None, None, None, None), ("a", "b", None, None, None), ("a", "b", "c", None, None), ("a", "b", "c", "d", "e")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    counts = cleaning.sparse_row_counts(df).first()
    assert tuple(counts) == (1, 1, 1, 2, 2)
    assert cleaning.sparse_row_filter(df).count() == 2
    assert cleaning.sparse_row_filter(df.select("a", "b"), as_coded=True).count() == 0
    assert cleaning.sparse_row_filter(df.select("a", "b"), as_coded=False).count() == 3


def test_cleaning_chain(spark):
    rows = [(" 1", "ann  lee", "01/02/1980", None, "x"), ("1", "ann lee", "1980-01-02", None, "x"), ("2", "N/A", "1981-03-04", None, "y"), (None, None, None, None, "z")]
    df = spark.createDataFrame(rows, "`Rec ID` string, `Full Name` string, `Birth Date` string, empty string, grp string")
    result = cleaning.clean_records(df, "Rec ID")
    assert result.data.columns == ["rec_id", "full_name", "birth_date", "grp"]
    assert sorted(map(tuple, result.data.select("rec_id", "full_name", "birth_date").collect()), key=str) == [("1", "ann lee", "1980-01-02"), ("2", None, "1981-03-04")]
    assert result.types == {"rec_id": "id", "full_name": "full_name", "birth_date": "dob", "grp": "text"}
    assert result.log["duplicates_removed"] == 1 and result.log["null_columns_dropped"] == ["empty"]
    assert result.log["summary"] == {"original_rows": 4, "rows_removed": 2, "final_rows": 2, "cols_removed": 1}
    assert result.log["null_rows_removed"]["n-1_null"] == 1


def test_bare_years_are_no_dates(spark):
    df = spark.createDataFrame([("1980", "x", "1980-05-06")] * 3, "birth_year string, update_note string, dob string")
    flags = {r["column"]: r["is_candidate"] for r in cleaning.date_candidates(df).collect()}
    assert flags == {"birth_year": False, "update_note": False, "dob": True}
    assert cleaning.standardise_dates(df)[1] == {"dob": "YYYY-MM-DD"}


def test_unparseable_dates_stay(spark):
    df = spark.createDataFrame([("a - b",), ("c / d",)], "start_date string")
    out, done = cleaning.standardise_dates(df)
    assert done == {} and values(out, "start_date") == ["a - b", "c / d"]


def test_ids(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("k")).repartition(3)
    plain = cleaning.ensure_unique_id(spark.range(5).select((F.col("id") * 2).alias("v")), prefix="A")
    assert sorted(values(plain, "unique_id")) == [f"A_{i}" for i in range(5)]
    assert cleaning.ensure_unique_id(df, "k").columns == ["unique_id"]
    a, b = cleaning.assign_ground_truth(spark.createDataFrame([("1",)], "unique_id string"), spark.createDataFrame([("1_B",), ("2",)], "unique_id string"))
    # Not all ids end in _B, so all get the suffix: 1_B and a plain 1 must stay apart.
    assert sorted((r["unique_id"], r["cluster"]) for r in b.collect()) == [("1_B_B", "1"), ("2_B", "2")]
    assert a.first()["cluster"] == "1"


def test_code_mapping(spark):
    df = spark.createDataFrame([("mostly_male",), ("andy",), ("??",), (None,)], "g string")
    assert values(df.select(cleaning.map_codes(F.col("g")).alias("g")), "g") == ["M", "Unknown", "Unknown", "Unknown"]


def test_types_and_suggestions():
    types = profiling.infer_types(["unique_id", "given", "family_nm", "nickname", "birth_state", "e_mail", "email", "zip", "sex", "town", "k"], "k")
    assert list(types.values()) == ["id", "first_name", "surname", "full_name", "dob", "text", "email", "postcode", "gender", "location", "id"]
    assert profiling.suggest_comparators(types)["family_nm"] == "JaroAtThresholds" and "k" not in profiling.suggest_comparators(types)
    assert profiling.suggest_blocking(types)["town"] and not profiling.suggest_blocking(types)["email"]
    fields, on = profiling.auto_select_fields(types, list(types), 3)
    assert fields == ["given", "family_nm", "birth_state"] and all(on.values())


def test_approximate_profile(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "unique_id string, first_name string")
    exact = profiling.schema_profile(df).select("column", "n_distinct", "pct_complete")
    rough = profiling.schema_profile(df, approximate=True).select("column", "n_distinct", "pct_complete")
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, rough.collect()))


def test_numbering_inside_a_hot_key(spark):
    rows = [("hot", str(i)) for i in range(500)] + [("cold", "1")]
    out = profiling.numbered(spark.createDataFrame(rows, "k string, v string"), "k", "v")
    hot = out.where("k = 'hot'")
    assert sorted(values(hot, "position")) == list(range(1, 501)) and set(values(hot, "n_values")) == {500}


# ---- cohorts ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def voters(spark):
    rows = [("1", "A", "NC", "1980"), ("2", "W", None, "1990"), ("3", "W", "VA", "n/a"), ("4", None, "NC", "2000")]
    return spark.createDataFrame(rows, "unique_id string, race_code string, birth_state string, birth_year string")


@pytest.mark.parametrize("filters,ids", [
    ({"categorical": {"race_code": []}, "ranges": {}}, "1234"),
    ({"categorical": {"race_code": ["W"]}}, "23"),
    ({"categorical": {"birth_state": ["NC"]}}, "124"),
    ({"categorical": {"birth_state": ["NC"]}, "birth_state_include_missing": False}, "14"),
    ({"ranges": {"birth_year": [1980, 2000]}}, "1234"),
    ({"ranges": {"birth_year": [1985, 2000]}}, "24"),
    ({"categorical": {"nope": ["x"]}, "ranges": {"gone": [1, 2]}}, "1234"),
])
def test_cohort_filter(voters, filters, ids):
    assert "".join(sorted(values(cohort.apply_cohort_filters(voters, filters), "unique_id"))) == ids


def test_cohort_defaults_and_documents(voters):
    start = cohort.default_filters(voters)
    assert start["ranges"] == {"birth_year": [1980, 2000], "age_at_year_end": [0, 0]}
    assert cohort.apply_cohort_filters(voters, start).count() == 4
    assert cohort.filters_from_json(cohort.filters_to_json(start, "x")) == start
    with pytest.raises(ValueError):
        cohort.filters_from_json("{}")


def test_decades(spark):
    years = ["1899", "1900", "1909", "1910", "2029", "2030", None, "x"]
    df = spark.createDataFrame([(y,) for y in years], "birth_year string")
    got = {r["value"]: r["n_records"] for r in demographics.binned_breakdown(df).collect()}
    assert got == {"1900s": 2, "1910s": 1, "2020s": 1}


def test_comparison_fields():
    assert demographics.comparison_fields(["gender", "zip", "race_code"], ["gender", "city"]) == (["gender"], ["race_code"], ["city"])


# ---- noise ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("before,after", [("2019-12-31", "2019-01-31"), ("2019-01-30", "2019-02-28"), ("2020-01-30", "2020-02-29"), ("soon", "soon"), (None, None)])
def test_shifted_dates(spark, before, after):
    df = spark.createDataFrame([(before,)], "d string")
    assert df.select(perturb.shift_date(F.col("d")).alias("d")).first()["d"] == after


def test_letters_change_exactly(spark):
    df = spark.createDataFrame([(str(i), "Ab-12 cD") for i in range(200)], "unique_id string, v string")
    for r in df.select(perturb.change_letters(F.col("v"), 2, "w", F.col("unique_id")).alias("v")).collect():
        differ = [(x, y) for x, y in zip("Ab-12 cD", r["v"]) if x != y]
        assert len(differ) == 2 and all(x.isalpha() and x.isupper() == y.isupper() for x, y in differ)


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("unique_id"), F.concat(F.lit("name"), "id").alias("first_name"),
                                 F.lit("1980-05-06").alias("dob"), F.lit("A").alias("source_dataset"))
    types = profiling.infer_types(df.columns)
    run = lambda n: sorted(map(str, perturb.derive_b_rates(df.repartition(n), types, 0.5, {"first_name": 0.5, "dob": 0.5}).collect()))
    assert run(1) == run(16)
    every = lambda n: sorted(map(str, perturb.derive_b_all_rows(df.repartition(n), types, 0.5).collect()))
    assert every(1) == every(16)


def test_derived_b_keeps_truth(spark):
    df = spark.createDataFrame([("1", "ann", None), ("2_B", "bob", "x")], "unique_id string, first_name string, city string")
    b = perturb.derive_b_rates(df, profiling.infer_types(df.columns), 1.0, {"city": 1.0})
    rows = {r["unique_id"]: r for r in b.collect()}
    assert rows["1_B"]["cluster"] == "1" and rows["1_B"]["city"] is None and rows["2_B"]["city"] == "X"
    assert {r["source_dataset"] for r in rows.values()} == {"B"}


def test_cap_on_unknowns(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("unique_id"),
                                  F.when(F.col("id") % 3 == 0, "Unknown").otherwise("M").alias("gender"),
                                  F.when(F.col("id") % 9 != 0, "n").alias("first_name"))
    out = perturb.capped_reassign(df)
    assert out.count() == 1000
    left = out.where("gender = 'Unknown'")
    assert left.count() == 112                      # 112 have no name and stay protected
    assert left.where("first_name is not null").count() == 0
    few = perturb.capped_reassign(df.withColumn("first_name", F.lit("n")))
    assert few.where("gender = 'Unknown'").count() == 100


def test_draws_are_spread(spark):
    rate = spark.range(4000).select((draw("x", F.col("id").cast("string")) < 2 ** 31).cast("int").alias("h")).agg(F.avg("h")).first()[0]
    assert 0.46 < rate < 0.54


def test_a_stored_clean_table_and_its_log_read_the_input_three_times(spark):
    reads = spark.sparkContext.accumulator(0)

    def rows(batches):
        reads.add(1)
        yield from batches

    source = spark.createDataFrame([("1", "ann", "2020-01-02", "x"), ("1", "ann", "2020-01-02", "x"), ("2", None, None, None), (None, None, None, None),
                                    ("3", "bob", "1999-5-6", None)], "id string, name string, `birth date` string, kind string").coalesce(1).mapInPandas(
        rows, "id string, name string, `birth date` string, kind string")
    result = cleaning.clean_records(source).store()
    log = result.log
    assert reads.value <= 3
    assert log["summary"] == {"original_rows": 5, "rows_removed": 3, "final_rows": 2, "cols_removed": 0} and log["duplicates_removed"] == 1
    assert sorted(r["id"] for r in result.data.collect()) == ["1", "3"] and reads.value <= 3
    assert cleaning.clean_records(source).log == log
    narrow = cleaning.clean_records(source.select("id", "name")).log
    assert narrow["summary"]["final_rows"] == 2 and narrow["duplicates_removed"] == 1


def test_letters_of_long_values_are_changed_in_time_linear_in_their_length(spark):
    """The places to change are worked out once a value, not once a character."""
    df = spark.createDataFrame([(str(i), "aBcDe" * 1200) for i in range(2)], "unique_id string, v string")
    started = time.monotonic()
    for r in df.select("v", perturb.change_letters(F.col("v"), 3, "w", F.col("unique_id")).alias("after")).collect():
        assert len(r["after"]) == 6000 and sum(a != b for a, b in zip(r["v"], r["after"])) == 3
    assert time.monotonic() - started < 30
