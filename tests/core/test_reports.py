"""Reports hold every row, or say what they leave out."""

from rulelens.sources import companions


def test_markdown_tables_leave_nothing_out_silently(spark):
    df = spark.range(0, 450, 1, 3)
    lines = companions.markdown_table(df).splitlines()
    assert lines[:2] == ["| id |", "| --- |"] and sorted(lines[2:]) == sorted(f"| {i} |" for i in range(450))
    cut = companions.markdown_table(df, 200).splitlines()
    assert len(cut) == 204 and cut[-1] == "250 more rows are left out."
    assert companions.markdown_table(df, 450) == companions.markdown_table(df)
