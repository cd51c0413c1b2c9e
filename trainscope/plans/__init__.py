"""Whole questions, composed of operators into one lazy plan each."""
