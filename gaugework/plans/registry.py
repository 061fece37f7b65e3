"""Registered queries of the evaluation engine, with the SQL each is held against."""

from gaugework.plans import core, decisions, evidence, hosts, measures, scorers, sources, trajectories

QUERIES = scorers.QUERIES | core.QUERIES | decisions.QUERIES | evidence.QUERIES | sources.QUERIES | measures.QUERIES | hosts.QUERIES | trajectories.QUERIES
ORACLE = scorers.ORACLE | core.ORACLE | decisions.ORACLE | evidence.ORACLE | sources.ORACLE | measures.ORACLE | hosts.ORACLE | trajectories.ORACLE
