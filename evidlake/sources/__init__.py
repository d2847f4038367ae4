"""Readers and writers: paged and recorded evidence, artefact files and events, frozen sets, reports, indexes."""
