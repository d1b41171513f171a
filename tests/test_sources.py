"""Loading, checking and publishing raw files."""

import hashlib
from dataclasses import replace

import pytest

from tallybook.presets import MUSIC, MUSIC_LAYOUT, MUSIC_TABLES
from tallybook.plans import datasets
from tallybook.sources import csv, manifest, publish

LAYOUT = csv.CsvLayout(
    columns=(("a", "int"), ("b", "double"), ("c", "string")), required=("a", "c")
)
HEADER, KINDS = "a,b,c", "numeric,numeric,string"


def write(tmp_path, *lines, name="data.csv"):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_type_line_is_not_data_and_fields_are_typed(spark, tmp_path):
    path = write(tmp_path, HEADER, KINDS, "2010.0,1.5,x", "7,,y")
    df = csv.load_raw(spark, path, LAYOUT)
    assert df.dtypes == [("a", "int"), ("b", "double"), ("c", "string")]
    assert sorted(map(tuple, df.collect())) == [(7, None, "y"), (2010, 1.5, "x")]


@pytest.mark.parametrize("token", ["Missing", "missing", "MISSING", "N/A", "n/a", "NA", "nan", ""])
def test_missing_tokens_match_whole_values(spark, tmp_path, token):
    path = write(tmp_path, HEADER, KINDS, f"1,{token},{token}", "2,3,Missing Persons")
    rows = {r.a: r for r in csv.load_raw(spark, path, LAYOUT).collect()}
    assert rows[1].b is None and rows[1].c is None
    assert rows[2].c == "Missing Persons"


def test_unparsable_and_nan_values_are_null(spark, tmp_path):
    path = write(tmp_path, HEADER, KINDS, "x,NaN,ok", "1,abc,ok")
    rows = csv.load_raw(spark, path, LAYOUT).collect()
    assert sorted((r.a is None, r.b is None) for r in rows) == [(False, True), (True, True)]


def test_wide_lines_are_left_out_and_reported(spark, tmp_path):
    path = write(
        tmp_path, HEADER, KINDS,
        "1,1,good", "2,2", '3,3,"quoted, comma"', "4,4,wide,extra", "5,5,wide,", "6,6,wide,,x",
    )
    with pytest.warns(UserWarning, match="3 malformed"):
        df = csv.load_raw(spark, path, LAYOUT)
    # a short line is padded, not malformed
    assert sorted((r.a, r.c) for r in df.collect()) == [
        (1, "good"),
        (2, None),
        (3, "quoted, comma"),
    ]
    report = csv.malformed_row_report(spark, path, LAYOUT).first()
    assert report.n_malformed == 3
    assert report.examples == ["4,4,wide,extra", "5,5,wide,", "6,6,wide,,x"]


def test_report_of_a_clean_file(spark, tmp_path):
    report = csv.malformed_row_report(spark, write(tmp_path, HEADER, KINDS, "1,1,x"), LAYOUT)
    assert report.first().asDict() == {"n_malformed": 0, "examples": []}


def test_column_list_is_checked_with_order(spark, tmp_path):
    path = write(tmp_path, "b,a,c", KINDS, "1,1,x")
    with pytest.raises(csv.SchemaError, match="another order: True"):
        csv.load_raw(spark, path, LAYOUT)
    with pytest.raises(csv.SchemaError, match="missing \\['c'\\], extra \\['z'\\]"):
        csv.load_raw(spark, write(tmp_path, "a,b,z", KINDS, "1,1,x"), LAYOUT)


def test_required_columns(spark):
    loose = csv.CsvLayout(columns=(("a", "int"),), required=("a", "q"))
    with pytest.raises(csv.SchemaError, match="required"):
        csv.check_columns(["a"], loose)


def test_every_file_needs_the_header(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder, HEADER, KINDS, "1,1,x", name="a.csv")
    write(folder, "2,2,y", name="b.csv")
    with pytest.raises(csv.SchemaError, match="1 file"):
        csv.load_raw(spark, str(folder), LAYOUT)


def test_wrong_row_count_raises(spark, tmp_path):
    names = MUSIC_LAYOUT.names
    path = write(tmp_path, ",".join(names), ",".join(["string"] * 34), "," * 33)
    with pytest.raises(csv.SchemaError, match="expected 277938 rows, found 1"):
        csv.load_raw(spark, path, MUSIC_LAYOUT)


def test_digest_equals_sha256_and_detects_tampering(spark, tmp_path):
    path = write(tmp_path, HEADER, KINDS, "1,1,x")
    found = manifest.file_digests(spark, path)
    content = open(path, "rb").read()
    assert found.first().digest == hashlib.sha256(content).hexdigest()
    expected = spark.createDataFrame([tuple(found.select("file", "digest").first())], "file string, digest string")
    manifest.validate_manifest(found, expected)
    with open(path, "a") as f:
        f.write("not,a,row\n")
    with pytest.raises(manifest.HashMismatchError, match="mismatch"):
        manifest.validate_manifest(manifest.file_digests(spark, path), expected)


def test_absent_file_fails_the_manifest(spark, tmp_path):
    found = manifest.file_digests(spark, write(tmp_path, HEADER))
    expected = spark.createDataFrame([("other.csv", "0")], "file string, digest string")
    with pytest.raises(manifest.HashMismatchError, match="absent"):
        manifest.validate_manifest(found, expected)


def test_files_are_told_by_their_relative_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_BYTES", 3)
    for folder in ("north", "south"):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder, HEADER, folder, name="part.txt")
    found = manifest.file_digests(spark, str(tmp_path))
    rows = {r.file: r.digest for r in found.collect()}
    assert rows == {
        f"{f}/part.txt": hashlib.sha256((tmp_path / f / "part.txt").read_bytes()).hexdigest()
        for f in ("north", "south")
    }
    manifest.validate_manifest(found, found.select("file", "digest"))


def test_quoted_line_breaks_are_read_in_the_default_load(spark, tmp_path):
    folder = tmp_path / "both"
    folder.mkdir()
    write(folder, HEADER, KINDS, "7,1.5,plain", "8,2.5,x", "9,9,9,9", "oops,1,y", name="plain.csv")
    write(folder, HEADER, KINDS, '1,2.5,"two', 'lines, of"', "4,5.0,x", name="last.csv")
    write(folder, HEADER, '2,3.5,"a', 'b,c,d"', '"3",4.5,"x ""q"" y"', name="shape.csv")
    with pytest.warns(UserWarning) as told:
        loaded = csv.load_counted(spark, str(folder), LAYOUT)
    assert sorted(map(tuple, loaded.rows.collect()), key=str) == sorted(
        [(7, 1.5, "plain"), (8, 2.5, "x"), (None, 1.0, "y"), (1, 2.5, "two\nlines, of"), (4, 5.0, "x"),
         (2, 3.5, "a\nb,c,d"), (3, 4.5, 'x "q" y')], key=str)
    found = loaded.counts
    assert (found.n_rows, found.n_malformed, found.n_headers, found.n_type_lines) == (7, 1, 3, 2)
    assert found.failed == {"a": 1, "b": 0, "c": 0}
    assert sum(issubclass(w.category, UserWarning) for w in told) == 2


def test_a_quote_that_is_never_closed_is_an_error(spark, tmp_path):
    for line in ('1,2.5,"two', '1,"two', '1,2,3,"two'):
        path = write(tmp_path, HEADER, KINDS, line, "4,5.0,x", "5,6.0,y")
        with pytest.raises(csv.RawDataError, match="never close"):
            csv.load_raw(spark, path, replace(LAYOUT, multi_line=True))
    # torn lines show it in the default load where a line's width or a stray quote does
    path = write(tmp_path, HEADER, KINDS, '1,"two', "4,5.0,x")
    with pytest.raises(csv.RawDataError, match="never close"):
        csv.load_raw(spark, path, LAYOUT)


def test_values_that_do_not_parse_are_counted(spark, tmp_path):
    path = write(tmp_path, HEADER, KINDS, "2.7,1.0,x", "oops,1.5,y", "3.0,much,z", "4,NaN,w")
    with pytest.warns(UserWarning, match="a: 2, b: 1"):
        rows = csv.load_raw(spark, path, LAYOUT).collect()
    assert sorted((str(r.a), r.c) for r in rows) == [
        ("3", "z"), ("4", "w"), ("None", "x"), ("None", "y")]


def test_a_file_has_one_type_line(spark, tmp_path):
    path = write(tmp_path, HEADER, KINDS, "string,string,string", "1,1.0,x")
    with pytest.raises(csv.SchemaError, match="more than one type line"):
        csv.load_raw(spark, path, LAYOUT)


def _music(spark, rows):
    schema = "track string, artist_1 string, popularity_score int, artist_1_genre_1 string"
    return spark.createDataFrame(rows, schema)


def test_publish_replaces_earlier_tables(spark):
    scores = (17, 3, 64, 88, 41)
    primary = _music(spark, [(f"tune {s}", "band", s, "folk" if s > 40 else None) for s in scores])
    publish.publish_views({MUSIC_TABLES["primary"]: primary})
    publish.publish_views({MUSIC_TABLES["sensitivity"]: primary.limit(4)})
    assert {"tracks_primary", "tracks_sensitivity"} <= set(publish.published_tables(spark))
    count = "SELECT count(*) AS n FROM tracks_primary"
    assert publish.run_query(spark, count).first().n == 5
    publish.publish_views({MUSIC_TABLES["primary"]: primary.limit(1)})
    assert publish.run_query(spark, count).first().n == 1


def test_saved_tables_are_switched(spark, tmp_path):
    rows = _music(spark, [("a", "x", 10, None), ("b", "y", 50, "pop")])
    other = rows.select("track")
    for i, expected in enumerate((rows, rows.limit(1), other)):
        paths = {}
        for name in ("saved_one", "saved_two"):
            paths[name] = f"{publish.new_version(str(tmp_path))}/it's {name}.parquet"
            expected.write.parquet(paths[name])
        publish.publish_tables(paths, spark)
        for name in paths:
            assert sorted(spark.table(name).collect()) == sorted(expected.collect())
        if i == 0:
            held = spark.table("saved_one")
            with pytest.raises(Exception, match="(?i)path"):
                publish.publish_tables({"saved_one": paths["saved_one"], "saved_two": f"{tmp_path}/none"}, spark)
            assert held.count() == spark.table("saved_two").count() == 2
    for name in ("saved_one", "saved_two"):
        spark.sql(f"DROP TABLE {name}")


def test_reconcile_finds_lost_rows_and_bad_scores(spark):
    source = _music(spark, [("a", "x", 10, None), ("b", "y", 50, None)])
    bad = _music(spark, [("a", "x", 101, None)])
    good = publish.reconcile(source, source, MUSIC, "t").first()
    assert good.rows_match and good.scores_in_bounds
    row = publish.reconcile(source, bad, MUSIC, "t").first()
    assert not row.rows_match and not row.scores_in_bounds


def _catalog_line(**values):
    return ",".join(str(values.get(name, "")) for name in MUSIC_LAYOUT.names)


def test_build_from_files_end_to_end(spark, tmp_path):
    base = dict(artist_1="X", popularity_score=80, release_date="2005.0", album_type="album",
                tempo=0, duration_ms=120000, popularity="2high")
    lines = [
        _catalog_line(track="t", **base),
        _catalog_line(track="t", **base),  # exact copy
        _catalog_line(track="t", **{**base, "release_date": "2001.0", "popularity_score": 5}),
        _catalog_line(track="u", **{**base, "release_date": "", "release_decade": 1990}),
    ]
    path = write(tmp_path, ",".join(MUSIC_LAYOUT.names), ",".join(["string"] * 34), *lines)
    layout = csv.CsvLayout(MUSIC_LAYOUT.columns, MUSIC_LAYOUT.required, expected_rows=4)
    digests = manifest.file_digests(spark, path)
    built = datasets.build_from_files(
        spark, path, layout, MUSIC, str(tmp_path / "out"), MUSIC_TABLES, digests
    )
    assert {r.dataset: r.n_rows for r in datasets.build_counts(built).collect()} == {
        "primary": 3,
        "sensitivity": 2,
    }
    stats = built.dedup_stats.first()
    assert (stats.rows_in_groups, stats.rows_removed, stats.rows_before) == (2, 1, 4)
    assert all(r.violations == 0 for r in datasets.post_checks(built, MUSIC).collect())
    rows = spark.sql("SELECT * FROM tracks_primary WHERE track = 'u'").first()
    assert rows.release_decade_clean == 1990 and rows.release_year is None
    assert rows.track_duration_minutes == 2.0 and rows.tempo_quality_flag == "zero_tempo"
    # the earliest release is kept, not the most popular
    kept = spark.sql("SELECT * FROM tracks_sensitivity WHERE track = 't'").first()
    assert kept.popularity_score == 5 and not kept.track_artist_duplicate_flag


def test_a_failing_build_leaves_the_former_tables(spark, tmp_path):
    head = [",".join(MUSIC_LAYOUT.names), ",".join(["string"] * 34)]
    layout = csv.CsvLayout(MUSIC_LAYOUT.columns, MUSIC_LAYOUT.required)
    names = {"primary": "kept_primary", "sensitivity": "kept_sensitivity"}
    base = dict(artist_1="X", release_date="2005.0", album_type="album", duration_ms=120000, popularity="2high")

    def build(*lines, **options):
        path = write(tmp_path, *head, *lines)
        digests = manifest.file_digests(spark, path)
        options = {"manifest": digests, **options}
        return datasets.build_from_files(
            spark, path, layout, MUSIC, str(tmp_path / "out"), names, as_tables=True, **options
        )

    def published():
        return [spark.table(n).count() for n in names.values()]

    build(_catalog_line(track="t", popularity_score=80, **base), _catalog_line(track="u", popularity_score=80, **base))
    assert published() == [2, 2]
    with pytest.raises(datasets.BuildError, match="score_out_of_range: 1"):
        build(_catalog_line(track="t", popularity_score=800, **base))
    with pytest.raises(ValueError, match="manifest"):
        build(manifest=None)
    wrong = spark.createDataFrame([("data.csv", "0")], "file string, digest string")
    with pytest.raises(manifest.HashMismatchError):
        build(manifest=wrong)
    assert published() == [2, 2]
    build(_catalog_line(track="t", popularity_score=80, **base))
    assert published() == [1, 1]
    build(manifest=None, check_digests=False)
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")
