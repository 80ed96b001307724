"""Evidence-centric entity analytics on Spark."""
