"""txnfeat: transaction analytics on PySpark."""
