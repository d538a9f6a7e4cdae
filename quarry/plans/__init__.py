"""Registered queries; importing the modules registers them."""
