"""Foliant: documentary analytics as Spark jobs (library, article, section, evidence)."""
