"""Readers, generators and the paged data source."""
