"""Tables written to the cluster's shared folder, to cut lineage or to be read twice alike."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


class Table:
    """df as Parquet under spark.checkpoint.dir (a local folder is set only where that is unset and everything runs on one machine)."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        sc = self.spark.sparkContext
        folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="lattica-shared-")
            sc.setCheckpointDir(folder)
        self.path = f"{folder.rstrip('/')}/lattica-{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
