"""Profiles count whole texts."""

from lexmill.operators import language


def test_profiles_count_whole_texts(spark):
    df = spark.createDataFrame([(1, "en", "ab " * 7_000 + "xyz" * 9_000)], "doc_id long, lang string, text string")
    assert language.profiles(df, size=1).first().trigram == "xyz"
    assert language.profiles(df, size=1, most_chars=language.MOST_CHARS).first().trigram == " ab"
