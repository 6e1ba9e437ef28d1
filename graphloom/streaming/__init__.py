"""Resumable evaluation in bounded pages."""
