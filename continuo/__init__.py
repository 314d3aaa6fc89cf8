"""Continuity analytics on Spark: agent-conversation memory as DataFrame plans."""
