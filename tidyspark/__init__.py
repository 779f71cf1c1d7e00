"""tidyspark: declarative cleaning and enrichment of columnar fact data on Spark."""
