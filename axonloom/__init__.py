"""Axonloom: Spark jobs for spike trains, electrode signals and text corpora."""
