
import pytest

from lemmata import queries
from lemmata.session import table
from tests.test_queries import SF


@pytest.mark.parametrize("name, k", [("vector_topk_every20", 4), ("vector_topk_l2_every20", 5)])
def test_searches_ask_with_every_id_divisible_by_20(spark, name, k):
    ids = [r["vec_id"] for r in table(spark, SF, "embeddings").select("vec_id").collect()]
    got = [r["qid"] for r in queries.QUERIES[name](spark, SF).collect()]
    assert sorted(got) == sorted(k * [i for i in ids if i % 20 == 0])
