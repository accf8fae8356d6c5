"""Sports-fixture analytics on PySpark: derivations, as-of features, ratings, calibration, decisions, tickets and evaluation."""
