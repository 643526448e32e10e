"""Finite sequences page by page, and an extension beyond them: windows over event streams."""
