"""Payment analytics as Spark jobs: batch and streaming operators over payment events."""
