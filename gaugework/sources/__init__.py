"""Readers, ingest checks and generated inputs."""
