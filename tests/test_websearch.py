"""Web searches settled in a chunk's own row, against the joins of words and places."""

import random

from quarry.operators import retrieval


def test_rows_of_their_own_give_what_the_joins_give(spark):
    dice = random.Random(11)
    words = lambda n: " ".join(dice.choice("abcdefg") for _ in range(n))
    rows = [(f"c{i:03}", "t", dice.choice("xy"), words(dice.randrange(1, 14)), dice.choice([None, "A b", "Title"])) for i in range(300)]
    live = spark.createDataFrame(rows, "chunk_id string, tenant_id string, space_id string, content string, title string").repartition(3)
    searches = ["a b", "a OR b", "a -b", "a b or c", '"b c"', '"a b" d or -"e f" g', '"a a"', "-a", "", "z", "a-b -c", '"a b c"', 'a "a b"', "b OR b", "title", "d e f g", 'or "b', "-a b OR -b a"]
    asked = spark.createDataFrame([(i, "t", s, 9 + i) for i, s in enumerate(searches)], "query_id long, tenant_id string, normalised string, candidate_limit int")
    scope = spark.createDataFrame([(i, "t", s) for i in range(len(searches)) for s in "xy" if (i + ord(s)) % 3], "query_id long, tenant_id string, space_id string")
    plain = lambda found: sorted((r["query_id"], r["rank"], r["chunk_id"], r["raw_score"], r["score"]) for r in found.collect())
    got = plain(retrieval.websearch(live, asked, scope))
    assert got == plain(retrieval.websearch_by_key(live, asked, scope)) and len(got) > 100
