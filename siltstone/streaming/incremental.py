"""Incremental scans with Structured Streaming.

The file source remembers which files it has seen, so a run takes only new ones; each micro-batch is
scanned by the batch plan and upserted into the history. A batch that runs again after a failure
writes the same rows again, so each file counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.config import Config
from siltstone.functions.scalars import parse_size
from siltstone.operators import rules as rule_sets
from siltstone.operators.lines import split_by_line_limit, split_lines
from siltstone.operators.rule_table import find
from siltstone.operators.listing import ARTIFACTS, artifacts, under_group
from siltstone.operators.rules import Rule
from siltstone.plans.scan import CARRIED, ScanResult, history_rows, scan_files
from siltstone.plans.store import Store
from siltstone.sources.files import relative

BINARY = "path string, modificationTime timestamp, length long, content binary"


def scan_stream(spark: SparkSession, config: Config, store: Store, checkpoint: str, progress: Callable[[int, ScanResult], None] | None = None, engines: dict | None = None) -> StreamingQuery:
    """Scan all artifacts that are new in the mirrored repository, then stop.

    ``checkpoint_interval`` is the number of files of a micro-batch, after each of which the
    position is kept.
    """
    config.validate()
    rules = rule_sets.load(config.rules_file or None, config.rules_level, config.rules_merge)
    files = (
        spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*{" + ",".join(ARTIFACTS) + "}").option("maxFilesPerTrigger", max(1, config.checkpoint_interval)).load(config.repo_url)
    )
    if most := parse_size(config.max_file_size):
        large = F.col("length") > most
        files = files.withColumn("error", F.when(large, F.concat(F.lit("too large: "), F.col("length").cast("string"), F.lit(f" bytes, limit {most}"))))
        files = files.withColumn("content", F.when(~large, F.col("content")))

    def batch(rows: DataFrame, number: int) -> None:
        found = artifacts(under_group(relative(rows, config.repo_url, "rel_path"), config.group, "rel_path"), "rel_path", config.include_sources, config.skip_pom, config.exclude or None)
        result = scan_files(found, rules, engines=engines, carried=CARRIED)
        now = found.sparkSession.sql("select current_timestamp()").first()[0]
        store.save(*history_rows(result, config.repo_url, now))
        if progress:
            progress(number, result)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detect_stream(texts: DataFrame, rules: Sequence[Rule], engines: dict | None = None) -> DataFrame:
    """Findings of a stream of (file_path, text): stateless, so any output mode and trigger will do. Files
    with an endless line are left out, as in a batch."""
    return find(split_lines(split_by_line_limit(texts)[0]), rules, engines)
