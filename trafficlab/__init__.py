"""trafficlab: traffic-sampling analytics on Spark.

Main entry points:

* ``trafficlab.operators.sampling``: ``sample_packets`` (modes 5-8),
  ``sample_flow`` (modes 1-4), ``with_position``
* ``trafficlab.operators.flows``: ``sessionize``, ``active_timeout``,
  ``caia_vector``, ``agm_vector``, ``flag_summary``
* ``trafficlab.operators.flowspec``: ``FlowSpec.from_json``, ``extract_flows``
* ``trafficlab.operators.labels``: ``label_flows``
* ``trafficlab.operators.prep`` / ``ml`` / ``evaluate``: preprocessing, model
  and metrics, experiment evaluation
* ``trafficlab.streaming.streams``: the streaming twins
"""

__version__ = "0.1.0"
