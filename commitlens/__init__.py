"""Software-dependency provenance as DataFrame operators on Spark."""
