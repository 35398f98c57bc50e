"""Readers: message streams, tables, files and generated calendars."""
