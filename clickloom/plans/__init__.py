"""The models and the jobs that build and refresh them."""
