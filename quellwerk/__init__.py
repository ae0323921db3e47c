"""quellwerk: a PySpark-native engine for analysing how answers use their web sources."""
