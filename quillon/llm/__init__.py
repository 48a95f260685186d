"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage; it can be deleted whole.
Every operator takes and returns DataFrames, keeps its intermediate tables in
the folder named by ``spark.checkpoint.dir`` and never collects a group, a
fingerprint set or a link set to the driver.
"""
