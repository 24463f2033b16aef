"""sparklode: a PySpark-native search and event-analytics engine."""
