"""Link analysis over bank ledgers, call records and internet sessions, on Spark."""
