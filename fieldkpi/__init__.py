"""Field-operations KPIs and before/after experiments as Spark DataFrame operators."""
