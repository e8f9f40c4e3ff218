"""runlens — agent-run analytics on Spark.

Operators over the data that coding agents and their evaluation runs leave
behind (trajectories, LLM calls, candidate patches, test logs, votes,
selection statistics, code symbols, documents), expressed as DataFrame / SQL
plans so Catalyst plans them and the work scales with the cluster.
"""

__version__ = "0.1.0"
