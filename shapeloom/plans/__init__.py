"""Composition: requests, services, validation and responses as DataFrame plans."""
