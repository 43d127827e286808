"""Model-audit and rule-explanation operators over Spark tables."""
