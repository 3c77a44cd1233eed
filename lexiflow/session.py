"""Spark session helpers.

On a cluster the session already exists and carries the shared
``spark.checkpoint.dir``; we only read it.  In tests and local runs we build
a local session and give it a scratch checkpoint folder when none is set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.driver.host": "127.0.0.1",
}


# Broadcast only on measured sizes: no estimate-based broadcast at planning time
# (estimates through explode/generate can be off by orders of magnitude); AQE
# converts a join to broadcast after the shuffle stages report real sizes.
SQL_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 << 20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows handed to pandas kernels carry whole texts (up to ~20k words each) and their words as
    # Python objects, many times the bytes: bound each Arrow batch by bytes as well as by records
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lexiflow`` importable by Python workers (``--py-files`` done once per
    application): the package is zipped on the driver and added with ``addPyFile``."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # remote sessions ship code through their own artifact API
        return
    if app in _SHIPPED:
        return
    import zipfile
    from pathlib import Path

    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lexiflow-pyfiles-")) / "lexiflow.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED.add(app)


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)
    return spark


def local_session(cpus: int | str = "*", app: str = "lexiflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a scratch one only when unset (tests)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            # executors on other machines cannot read a driver-local folder
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder for checkpoints")
        conf = tempfile.mkdtemp(prefix="lexiflow-ckpt-")
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (metadata only, no data read)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))
