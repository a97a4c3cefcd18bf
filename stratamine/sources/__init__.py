"""Readers and writers of the formats that the mining tasks use."""
