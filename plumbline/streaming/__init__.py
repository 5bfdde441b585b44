"""Validating data as it arrives."""
