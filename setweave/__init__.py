"""Set analytics on Spark: declarative operators over item sets, predictions and corpora."""
