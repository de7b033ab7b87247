"""Readers. CSV and JSON readers plan lazily; sheet readers stage the lines of their files first."""
