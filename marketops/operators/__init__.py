"""Operators over market-event tables. Every one is lazy and takes policy as data."""
