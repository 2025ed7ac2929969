"""Part of the rillhouse package."""
