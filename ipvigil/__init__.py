"""ipvigil: threat-event analytics over reported IP addresses, written as Spark DataFrame jobs."""
