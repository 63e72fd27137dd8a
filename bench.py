"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import catalogue  # noqa: E402
from tessera.session import get_session  # noqa: E402

HEADLINE = [
    "flagship", "filter_and", "join_chain", "join_group", "group_two", "sort_multi", "geo_range_haversine", "geo_knn", "geo_batch_knn",
    "text_bm25", "text_batch", "text_tfidf", "vec_cosine", "vec_batch_topk", "bow_tfidf", "audio_align", "rec_copurchase", "rec_fusion", "rec_baskets", "eval_ndcg_mrr", "dml_update",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench")
    catalogue.QUERIES["flagship"](spark, sf_dir).collect()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
