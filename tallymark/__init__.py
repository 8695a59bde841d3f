"""Receipt reconciliation and corpus preparation as Spark DataFrame jobs."""
