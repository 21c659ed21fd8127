"""The pipeline's stages on odd and empty tables."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import empty_documents, odd_documents
from tests.llm.test_dedup import brute_components

SMALL = "/root/testdata/sf0.001"


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    """Null and repeated ids, null and empty texts, clashing columns: each stage keeps the columns and does what it says."""
    import corpus_pipeline

    odd = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    white = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x or "")
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SMALL).schema == odd.schema and stage(spark, empty_documents(spark), SMALL).count() == 0, name
    assert set(rows(stages["toxicity"](spark, odd, SMALL))) <= set(rows(odd))
    once = stages["exact_dedup"](spark, odd, SMALL)
    assert Counter(white(x) for _, x in rows(once)) == Counter({white(x) for _, x in rows(odd)})
    near = rows(stages["minhash_near_dedup"](spark, once, SMALL))
    keep = {(i, c) for i, _, c in brute_components(rows(once))}
    assert sorted(near, key=repr) == sorted(((i, x) for i, x in rows(once) if (i, i) in keep), key=repr)
    cut = rows(stages["suffix_dedup"](spark, odd, SMALL))
    assert Counter(i for i, _ in cut) == Counter(i for i, _ in rows(odd)) and sum(len(x or "") for _, x in cut) < sum(len(x or "") for _, x in rows(odd))
    packed = stages["packing"](spark, odd, SMALL)
    assert packed.groupBy().agg(F.sum("length")).first()[0] > 0 and stages["packing"](spark, empty_documents(spark), SMALL).count() == 0
