"""Quality datasets: defect assessments and defect lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.operators.relational import left_join_spread, pick
from cropline.plans import dimensions as dim
from cropline.plans.dimensions import Tables

# Template ids of the defect assessments in the source database.
DEFECT_TEMPLATES = (13, 14, 28)


def assessments(t: Tables, templates: Sequence[int]) -> DataFrame:
    return pick(
        t["qa_AssessmentT"].filter(F.col("TemplateID").isin(list(templates))),
        assessment_id="AssessmentID", grader_batch_id="GraderBatchID", lot_id="GraderBatchMPILotID",
        bin_delivery_id="BinDeliveryID", template_id="TemplateID", season_id="SeasonID", farm_id="FarmID",
        block_id="BlockID", sample_qty="SampleQty", assessed_at="AssessmentDateTime",
    )


def defect_lines(t: Tables) -> DataFrame:
    return pick(
        t["qa_Assessment_DefectT"], assessment_defect_id="AssessmentDefectID", assessment_id="AssessmentID",
        defect_id="DefectID", defect_qty="DefectQty",
    )


def defect_names(t: Tables) -> DataFrame:
    return pick(t["qa_DefectT"], defect_id="DefectID", defect="Defect", mkt_defect_code="MktDefectCode")


def defect_assessments(t: Tables, templates: Sequence[int] = DEFECT_TEMPLATES) -> DataFrame:
    names = pick(t["qa_TemplateT"], template_id="TemplateID", template_name="TemplateName")
    return (
        assessments(t, templates)
        .join(names, "template_id")
        .join(dim.seasons(t), "season_id")
        .select(
            "assessment_id", "season", "grader_batch_id", "template_name", "bin_delivery_id", "assessed_at",
            "sample_qty",
        )
    )


def defects(t: Tables) -> DataFrame:
    """Every defect line with its name, whatever the template."""
    return (
        defect_lines(t)
        .join(defect_names(t), "defect_id")
        .select("assessment_defect_id", "assessment_id", "defect", "defect_qty")
    )


def defect_assessment_summary(t: Tables, templates: Sequence[int] = DEFECT_TEMPLATES) -> DataFrame:
    """Defects by season, farm, site, block, batch and defect, with the fruit sampled in that batch."""
    assessed = assessments(t, templates)
    keys = ["season", "rpin", "orchard", "production_site", "management_area", "grader_batch_id", "defect"]
    found = (
        defect_lines(t)
        .join(assessed, "assessment_id")
        .join(defect_names(t), "defect_id")
        .join(dim.farms(t), "farm_id")
        .join(dim.blocks(t), "block_id")
        .join(dim.subdivisions(t), "subdivision_id")
        .join(dim.seasons(t), "season_id")
        .withColumnsRenamed({"farm_code": "rpin", "farm_name": "orchard", "block_code": "management_area"})
        .groupBy(*keys)
        .agg(F.sum("defect_qty").alias("defect_qty"))
    )
    sampled = assessed.groupBy("grader_batch_id").agg(F.sum("sample_qty").alias("sample_qty"))
    return left_join_spread(found, sampled, "grader_batch_id", keys[:-2] + keys[-1:]).select(*keys, "defect_qty", "sample_qty")
