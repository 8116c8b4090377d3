"""Stage hand-off files and program configuration files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_SCHEMA = (
    "programId string, programName string, enabled boolean, marketplaces array<string>, "
    "dataConnectors array<struct<connectorId:string,connectorType:string,enabled:boolean,sourceConfig:map<string,string>,fieldMappings:map<string,string>>>, "
    "scoringModels array<struct<modelId:string,modelType:string,enabled:boolean,modelConfig:map<string,string>>>, "
    "filters array<struct<filterId:string,filterType:string,enabled:boolean,parameters:map<string,string>,`order`:int>>, "
    "channels array<struct<channelId:string,channelType:string,enabled:boolean,config:map<string,string>>>, "
    "batchSchedule string, reactiveEnabled boolean, candidateTTLDays int, timingWindowDays int, _corrupt string"
)


def stage_path(root: str, execution: str, stage: str) -> str:
    return f"{root}/executions/{execution}/{stage}/output"


def write_stage(df: DataFrame, root: str, execution: str, stage: str, fmt: str = "parquet") -> str:
    """Write a stage's output, replacing an earlier attempt of the same stage."""
    path = stage_path(root, execution, stage)
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def read_stage(spark: SparkSession, root: str, execution: str, stage: str, fmt: str = "parquet") -> DataFrame:
    """Read a stage's output; a missing one is an error that names the failed stage."""
    try:
        return spark.read.format(fmt).load(stage_path(root, execution, stage))
    except AnalysisException as exc:
        raise FileNotFoundError(f"stage '{stage}' of execution '{execution}' left no output; did it fail?") from exc


def parse_program_configs(df: DataFrame, column: str = "value") -> DataFrame:
    """Typed configs from JSON text; malformed rows are dropped."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.select(F.from_json(F.col(column), CONFIG_SCHEMA, opts).alias("c")).select("c.*")
    return parsed.filter(F.col("_corrupt").isNull() & F.col("programId").isNotNull()).drop("_corrupt")


def load_program_configs(spark: SparkSession, path: str) -> DataFrame:
    return parse_program_configs(spark.read.text(path))
