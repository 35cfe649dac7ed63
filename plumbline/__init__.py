"""plumbline: evaluation, reconciliation and document operators as lazy PySpark DataFrame functions."""
