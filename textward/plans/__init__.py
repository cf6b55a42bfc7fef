"""textward.plans"""
