"""Where registered queries write what they make on the way."""

import tempfile
import uuid


def scratch(spark, label):
    """A new folder that all executors share: the cluster's, or on one machine without any a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="fieldlab-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
