"""The ingest as a job: ``python -m quillstone --root DOCS --index INDEX [--dry-run]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import chunking
from .plans import pipeline
from .sources import index


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs the ingest and prints what was done as JSON."""
    p = argparse.ArgumentParser(prog="quillstone", description="Makes an index hold exactly what a folder of Markdown holds.")
    p.add_argument("--root", required=True, help="folder of the documents")
    p.add_argument("--index", required=True, help="folder of the index")
    p.add_argument("--dry-run", action="store_true", help="check and count, write nothing")
    p.add_argument("--tokenizer", help="a tokenizer file; without it, characters count")
    p.add_argument("--max-tokens", type=int, default=512)
    p.add_argument("--overlap", type=float, default=0.12, help="part of a chunk's room that the next one repeats")
    p.add_argument("--prune", action="store_true", help="remove versions that no manifest names")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillstone").getOrCreate()
    count, most = chunking.characters, chunking.token_limit(a.max_tokens, a.max_tokens)
    if a.tokenizer:
        count, most = chunking.tokenizer_from(a.tokenizer, {"max_seq_length": most, "model_max_length": most})
    done = pipeline.ingest(spark, a.root, a.index, count, most, a.overlap, dry_run=a.dry_run).first().asDict()
    if a.prune and not a.dry_run:
        done["pruned"] = index.prune(spark, a.index)
    print(json.dumps(done, ensure_ascii=False, indent=2))
    return done


if __name__ == "__main__":
    main()
