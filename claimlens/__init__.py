"""claimlens: a PySpark engine that audits textual explanations against their evidence."""
