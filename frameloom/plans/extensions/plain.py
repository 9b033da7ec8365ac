"""A module without steps."""
