"""Cases of a review in which the training-data operators did less than the whole job."""

from lexmill.llm import decontaminate, line_dedup, near_dedup, secrets


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_equal_short_lines_go_at_every_length(spark):
    near = "a line of thirty or more code points {}"
    df = docs(spark, "x\nLes.\n\n" + near.format(1), " Les.\n\nx \nLes!\n" + near.format(2), "Les.\nx")
    got = {r.doc_id: r._left for r in line_dedup.with_lines_left(df, shortest=line_dedup.ANY_LENGTH).collect()}
    assert got == {0: "x\nLes.\n\n" + near.format(1), 1: "\nLes!", 2: ""}
    assert sorted(r.doc_id for r in line_dedup.deduplicated(df).collect()) == [0, 1]


def test_links_of_subsets_with_small_sketches(spark):
    # 60 to 130 shingles: sketches hold values of the upper half, and the two sides are cut at different places
    texts, want = [], {}
    for k in range(240):
        n = 80 + k % 51
        m = -(-n * 3 // 4) + k % 2
        assert 0.75 <= m / n < 0.78
        words = [f"w{k}x{i}" for i in range(n + 4)]
        texts += [" ".join(words), " ".join(words[: m + 4])]
        want |= {2 * k: (n, 2 * k), 2 * k + 1: (m, 2 * k)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, *texts)).collect()}
    assert got == want


def found(spark, items, *texts, **how):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.verbatim) for r in decontaminate.matches(docs(spark, *texts), items, **how).collect())


def test_every_item_of_a_template_is_searched(spark):
    one = "the farmer puts {} red apples into a basket and the baker puts {} green pears into another basket"
    items = [one.format(3, 3), one.format(3, 4)]
    assert found(spark, items, "so " + one.format(3, 4), "so " + one.format(7, 7), "so " + one.format(7, 9)) == [(0, 1, True), (1, 0, False), (2, 1, False)]


def test_whole_copies_that_templates_cannot_show(spark):
    items = ["Zorba sells quinces daily.", "7 8 9 10 11 12 13 14 15", "Marta paints eleven wooden boats near the old harbour.", "every evening old Tom and Eve walk to Rome together"]
    texts = ["we hear zorba sells quinces daily, though", "as in 7 8 9 10 11 12 13 14 15 and so on", "then Marta paints eleven wooden boats near the old harbour", "every evening old tom and eve walk to rome together", "zorba sells quinces. 7 8 9 10 11 12 13 14 16", "then Paula paints eleven wooden boats near the old harbour"]
    want = [(0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (5, 2, False)]
    assert found(spark, items, *texts) == want and found(spark, items, *texts, broadcast_rows=0) == want


def test_repositories_of_one_owner_decide(spark):
    few, many = "aB3dE5fG7hJ9kL1mN2pQ4r", "xY9zW8vU7tS6rQ5pO4nM3l"
    rows = [(k, f"{many} {few}" if k < 3 else many, f"repo{k}", "owner") for k in range(4)]
    got = {r.doc_id: (r.spans, r.n_live) for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string"), "repo", "owner").collect()}
    assert got == {**{k: ("live:23:45", 1) for k in range(3)}, 3: ("", 0)}
