"""Code-history analytics on Spark: structure facts, edit checks, decision logs."""
