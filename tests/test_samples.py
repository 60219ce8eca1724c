"""Sample files: records of any width and cells with line breaks."""

from __future__ import annotations

import csv

import pytest

from taxoflow.sources import samples as S


@pytest.mark.parametrize("kind", ["csv", "tsv"])
def test_whole_records(spark, tmp_path, kind):
    path = tmp_path / f"s.{kind}"
    data = [["Id", "Text"], ["a", "one, two"], ["b", *(f"w{i}" for i in range(700))], ["c", "first\nsecond", "x"], ["d"], ["e", "", *[""] * 80, 'say "hi"\t']]
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, delimiter=S.DELIMITERS[f".{kind}"]).writerows(data)
    got = [(r.sample_id, r.sample_desc) for r in S.read_samples(spark, str(path)).orderBy("row_key").collect()]
    assert [(i, t.split()) for i, t in got] == [(r[0], " ".join(r[1:]).split()) for r in data[1:]]
    assert got[2][1] == "first\nsecond x"


def test_streams_raise_on_wider_records(spark, tmp_path):
    def run(name, width):
        q = S.stream_samples(spark, str(tmp_path), width=width).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return {(r.sample_id, r.sample_desc) for r in spark.table(name).collect()}

    (tmp_path / "s.csv").write_text('a,b,c,d\ne,"f\ng"\n')
    assert run("wide_enough", 4) == {("a", "b c d"), ("e", "f\ng")}
    with pytest.raises(Exception, match="more than 3 columns"):
        run("too_narrow", 3)


def test_several_files_and_parts(spark, tmp_path):
    from taxoflow.operators import lexicon

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Id,Text\n1,one\n2,two\n")
    (tmp_path / "in" / "b.csv").write_text("Key,Other\n3,three\n")
    assert sorted(r.key for r in lexicon.lexicon_rows(spark, f"{tmp_path}/in", "k").collect()) == ["1", "2", "3"]
    rows = S.without_headers(spark.read.csv(f"{tmp_path}/in", schema="c0 string, c1 string").selectExpr("c0", "monotonically_increasing_id() as row_key"), "row_key")
    assert sorted(r.c0 for r in rows.collect()) == ["1", "2", "3"]
    empty = "array()"
    done = spark.range(5).selectExpr("id as row_key", "cast(id as string) as sample_id", "'x' as sample_desc", "'c' as cleaned", "'s' as cleaned_sci", f"cast({empty} as array<string>) as matched", "'No Match' as macro")
    S.write_parts(done, str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [f"{i}\tx\tc\ts\t[]\tNo Match" for i in range(5)]
