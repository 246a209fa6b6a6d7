"""Personal-data exposure audit and mail labelling as PySpark DataFrame jobs."""
