import os
import tempfile

from pyspark.sql import SparkSession


def spark_session(cores="8"):
    b = (SparkSession.builder.master(f"local[{cores}]").appName("panelspark")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
         .config("spark.sql.adaptive.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-ckpt-"))
    return spark
