"""Cloudweave: point-cloud and corpus analytics expressed as Spark plans."""
