"""A store of immutable snapshots: Parquet partitions by snapshot, and a manifest that says which of them are complete."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "snapshot_id string, experiment_tag string, run_id string, schema_version int, status string, created_at timestamp"
COUNTS = "snapshot_id string, name string, n_rows long"
ARTIFACTS = "snapshot_id string, report_name string, kind string, path string, metadata string, created_at timestamp"


class ContractError(ValueError):
    """All that a store lacks of what a contract names, or has otherwise."""


class SnapshotStore:
    """Tables below one folder. A reader sees a snapshot only once its last table is written and its manifest row appended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        return self._rows("manifest", MANIFEST)

    def completed(self) -> DataFrame:
        return self.manifest().where("status = 'completed'")

    def latest(self) -> DataFrame:
        """The newest complete snapshot of each tag."""
        newest = Window.partitionBy("experiment_tag").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
        return self.completed().withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at")

    def tags(self) -> DataFrame:
        return self.completed().select("experiment_tag").distinct().orderBy("experiment_tag")

    def export(self, tag: str, run_id: str, tables: dict[str, DataFrame], schema_version: int = 3, refresh: bool = False) -> str:
        """Write a run's tables and return the snapshot's id; a complete snapshot of the same run and version is used again."""
        have = self.completed().where((F.col("run_id") == run_id) & (F.col("schema_version") == schema_version)).orderBy(F.desc("created_at")).first()
        if have and not refresh:
            return have["snapshot_id"]
        snapshot = uuid.uuid4().hex
        for name, df in tables.items():
            df.withColumn("snapshot_id", F.lit(snapshot)).write.mode("append").partitionBy("snapshot_id").parquet(f"{self.path}/{name}")
        counts = functools.reduce(DataFrame.unionByName, (self._own(name, snapshot).agg(F.count("*").alias("n_rows")).select(F.lit(snapshot).alias("snapshot_id"), F.lit(name).alias("name"), "n_rows") for name in tables))
        counts.coalesce(1).write.mode("append").parquet(f"{self.path}/table_counts")
        row = self.spark.range(1).select(*(F.lit(x).alias(c) for c, x in (("snapshot_id", snapshot), ("experiment_tag", tag), ("run_id", run_id), ("schema_version", schema_version), ("status", "completed"))), F.current_timestamp().alias("created_at"))
        row.write.mode("append").parquet(f"{self.path}/manifest")
        return snapshot

    def _own(self, name: str, snapshot: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("snapshot_id") == snapshot)

    def manifest_of(self, snapshot: str) -> dict:
        """What the manifest says of a complete snapshot, with the rows of its tables; an error if it says nothing."""
        row = self.completed().where(F.col("snapshot_id") == snapshot).first()
        if row is None:
            raise KeyError(f"no complete snapshot {snapshot}")
        counts = self._rows("table_counts", COUNTS).where(F.col("snapshot_id") == snapshot).collect()  # a row a table
        return row.asDict() | {"tables": {r["name"]: r["n_rows"] for r in counts}}

    def required_run(self, tag: str | None = None, run_id: str | None = None) -> dict:
        """The newest complete snapshot of a run, or of a tag; an error if there is none, or the run is another tag's."""
        if not tag and not run_id:
            raise ValueError("name a tag or a run")
        rows = self.completed().where(F.col("run_id") == run_id if run_id else F.col("experiment_tag") == tag)
        row = rows.orderBy(F.desc("created_at"), F.desc("snapshot_id")).first()
        if row is None:
            raise KeyError(f"no complete snapshot of {run_id or tag}")
        if tag and row["experiment_tag"] != tag:
            raise ContractError(f"run {run_id} is of {row['experiment_tag']}, not of {tag}")
        return row.asDict()

    def register_artifacts(self, snapshots: list[str], report: str, kind: str, path: str, metadata: dict | None = None) -> None:
        """Note a table, figure or text that was made from these snapshots."""
        rows = self.spark.createDataFrame([(s, report, kind, path, json.dumps(metadata or {}, sort_keys=True)) for s in snapshots], "snapshot_id string, report_name string, kind string, path string, metadata string")
        rows.coalesce(1).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/artifacts")

    def artifacts(self) -> DataFrame:
        """Every artifact once for a snapshot, kind and path, as it was noted last."""
        last = Window.partitionBy("snapshot_id", "kind", "path").orderBy(F.desc("created_at"))
        return self._rows("artifacts", ARTIFACTS).withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at")

    def bundle(self, names: list[str], snapshots: list[str] | None = None, tags: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables ``names`` of these snapshots, or of the newest complete ones of the tags."""
        if snapshots is None:
            if not tags:
                raise ValueError("name snapshots or tags")
            snapshots = [r["snapshot_id"] for r in self.latest().where(F.col("experiment_tag").isin(tags)).collect()]  # a row a tag
        return {name: self.load(name, snapshots) for name in names}

    def problems(self, contract: dict) -> list[str]:
        """What speaks against a contract: ``snapshot_ids``, ``experiment_tags``, and if given ``export_schema_version`` and ``row_counts`` by table."""
        wanted, found = contract["snapshot_ids"], {}
        out = [f"snapshot named twice: {s}" for s in sorted({s for s in wanted if wanted.count(s) > 1})]
        for s in dict.fromkeys(wanted):
            try:
                found[s] = self.manifest_of(s)
            except KeyError:
                out.append(f"snapshot missing or incomplete: {s}")
        tags = {m["experiment_tag"] for m in found.values()}
        out += [f"tag missing: {t}" for t in sorted(set(contract["experiment_tags"]) - tags)] + [f"tag not in the contract: {t}" for t in sorted(tags - set(contract["experiment_tags"]))]
        version = contract.get("export_schema_version")
        out += [f"schema version {m['schema_version']} of {s}, not {version}" for s, m in found.items() if version is not None and m["schema_version"] != version]
        for name, rows in contract.get("row_counts", {}).items():
            have = sum(m["tables"].get(name, 0) for m in found.values())
            out += [f"{have} rows of {name}, not {rows}"] * (have != rows)
        return out

    def bound(self, contract: dict, names: list[str]) -> dict[str, DataFrame]:
        """The tables of exactly the snapshots that a contract names; an error that lists everything else."""
        if found := self.problems(contract):
            raise ContractError("; ".join(found))
        return self.bundle(names, snapshots=contract["snapshot_ids"])

    def load(self, name: str, snapshots: list[str] | None = None) -> DataFrame:
        """Complete snapshots of a table, pruned to the partitions asked for; columns added later are null in older ones."""
        df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")
        if snapshots is not None:
            return df.where(F.col("snapshot_id").isin(snapshots))
        return df.join(self.completed().select("snapshot_id"), "snapshot_id", "left_semi")


def batch_requests(rows: DataFrame) -> DataFrame:
    """One line of JSON for each request (``custom_id, model, system_prompt, user_prompt``), to be written as text."""
    messages = F.array(F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content")), F.struct(F.lit("user").alias("role"), F.col("user_prompt").alias("content")))
    body = F.struct(F.col("model").alias("model"), messages.alias("messages"))
    return rows.select(F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("value"))


def batch_results(lines: DataFrame) -> DataFrame:
    """``custom_id, status, output, error`` of result lines: an error, a status from 400 on or an empty output is an error."""
    schema = "custom_id string, error struct<message: string>, response struct<status_code: int, body: struct<choices: array<struct<message: struct<content: string>>>>>"
    r = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    output = F.get("response.body.choices", F.lit(0))["message"]["content"]
    failed = F.col("error").isNotNull() | (F.coalesce(F.col("response.status_code"), F.lit(200)) >= 400) | (F.coalesce(F.trim(output), F.lit("")) == "")
    return r.select("custom_id", F.when(failed, "error").otherwise("completed").alias("status"), output.alias("output"), F.coalesce(F.col("error.message"), F.when(failed, F.concat(F.lit("status "), F.coalesce(F.col("response.status_code").cast("string"), F.lit("unknown"))))).alias("error"))
