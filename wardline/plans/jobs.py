"""Whole jobs composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, detect
from ..session import scratch_path
from ..sources import tables
from ..sources.corpus import spread
from .detection import KNOWLEDGE_SQL, ROUTED_EXPECTED, _expected
from .registry import Tables, query


def scan_and_store(files: DataFrame, path: str, second: str = "knowledge") -> DataFrame:
    """Scan a corpus, append its findings to the table and return the summary per scan.

    Files carry their ``analysis_id``. Only findings are joined back to it, and
    the summary reads the stored rows, so nothing is detected twice.
    """
    found = detect.scan_corpus(files, second=second)
    owners = files.select(F.col("file_id").cast("string").alias("file_id"), "analysis_id")
    tables.append_findings(found.join(owners, "file_id"), path)
    stored = tables.load_table(files.sparkSession, path, "findings")
    stage = F.get_json_object("finding_metadata", "$.stage").cast("int")
    return aggregates.scan_summary(stored.select("analysis_id", "analyzer_type", stage.alias("stage")))


@query(
    "d11_scan_job",
    f"with first as ({_expected(ROUTED_EXPECTED)}), again as ({KNOWLEDGE_SQL}),"
    " rows as (select file_id, cwe_id, line_start, confidence, 1 as stage, starts_with(rule, 'flow:') as flow from first union all select file_id, cwe_id, line_start, 0.85, 2, false from again),"
    " won as (select *, row_number() over (partition by file_id, cwe_id, line_start order by confidence desc, stage) as r from rows),"
    " f as (select p.analysis_id, w.stage, w.stage = 1 and (w.flow or p.language in ('javascript', 'typescript')) as flow from won w join v_programs p on w.file_id = p.file_id where r = 1)"
    " select cast(analysis_id as varchar) as analysis_id, count(*) as total_findings, count(*) filter (where flow) as sast_findings,"
    " count(*) filter (where stage = 1 and not flow) as ast_findings, count(*) filter (where stage = 2) as ai_findings,"
    " case when count(*) filter (where flow) > 0 then 'sast+taint' else 'direct_ast' end as scan_method from f group by 1",
)
def _(t: Tables):
    return scan_and_store(spread(t.v_programs), scratch_path(t.spark, "scan"))
