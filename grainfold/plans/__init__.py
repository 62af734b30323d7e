"""grainfold.plans"""
