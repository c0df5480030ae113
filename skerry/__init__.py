"""Entity, evidence and corpus analytics as Spark jobs."""
